"""Slots for models that score (query, text) pairs: loaded once a task, fed by batches, allowed to fail."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Scorer = Callable[[Sequence[tuple[str, str]]], Sequence[float]]


@dataclass
class Slot:
    """How to get a scorer, and how to treat it.

    load is called once in each task that has rows for the slot. A batch has at most max_rows pairs
    and, unless one pair alone has more, max_tokens words. A call that raises, or gives another
    number of scores, or one that isn't finite, is repeated up to retries times, after a pause that
    doubles; then the batch has no scores.
    """

    load: Callable[[], Scorer]
    max_tokens: int = 4096
    max_rows: int = 64
    retries: int = 2
    pause: float = 0.0


def batches(sizes: Sequence[int], max_tokens: int, max_rows: int) -> list[tuple[int, int]]:
    """Runs of rows within both bounds, in order."""
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and (total + n > max_tokens or i - first >= max_rows):
            out.append((first, i))
            first, total = i, 0
        total += n
    return [*out, (first, len(sizes))] if len(sizes) else []


def _call(scorer: Scorer, pairs: list[tuple[str, str]], slot: Slot) -> tuple[list[float | None], str | None]:
    for turn in range(slot.retries + 1):
        try:
            scores = [float(s) for s in scorer(pairs)]
            if len(scores) != len(pairs) or not all(map(math.isfinite, scores)):
                raise ValueError("scores missing")
            return scores, None
        except Exception as e:  # any fault of a model is the batch's, not the job's
            fault = f"{type(e).__name__}: {e}"
            if turn < slot.retries and slot.pause:
                time.sleep(slot.pause * 2**turn)
    return [None] * len(pairs), fault


def score_pairs(rows: DataFrame, slots: dict[str, Slot], default: str | None = None) -> DataFrame:
    """rows(mode, query, text, ...) with model_score and model_fault (what the last try of a batch said, null if it was fine).

    A mode without a slot takes the default's; without that its rows have no score and no fault.
    Null queries and texts are empty. Rows stay in their task: nothing is shuffled.
    """
    names = [f.name for f in rows.schema.fields]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, Scorer] = {}
        for pdf in parts:
            score, fault = [None] * len(pdf), [None] * len(pdf)
            modes = [m if m in slots else default for m in pdf["mode"]]
            for mode in dict.fromkeys(m for m in modes if m is not None):
                slot, at = slots[mode], [i for i, m in enumerate(modes) if m == mode]
                pairs = [(q if isinstance(q, str) else "", t if isinstance(t, str) else "") for q, t in zip(pdf["query"].iloc[at], pdf["text"].iloc[at], strict=True)]
                for a, b in batches([len(q.split()) + len(t.split()) for q, t in pairs], slot.max_tokens, slot.max_rows):
                    try:
                        if mode not in loaded:
                            loaded[mode] = slot.load()
                        found, why = _call(loaded[mode], pairs[a:b], slot)
                    except Exception as e:
                        found, why = [None] * (b - a), f"{type(e).__name__}: {e}"
                    for i, s in zip(at[a:b], found, strict=True):
                        score[i], fault[i] = s, why
            yield pdf[names].assign(model_score=pd.Series(score, pdf.index, "float64"), model_fault=pd.Series(fault, pdf.index, "object"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, model_score double, model_fault string")


def rerank_pairs(hits: DataFrame, slots: dict[str, Slot], k: int, least: float | None = None, default: str | None = None) -> DataFrame:
    """(qid, id, pos, model_score, fell_back): hits(qid, mode, id, rank, query, text) by their mode's model, the first k of each query.

    A query with a hit that has no score keeps the order it had, as does one whose hits are all
    under least; else hits under least go. Ties go by rank, then id.
    """
    s = score_pairs(hits.select("qid", "mode", "id", "rank", "query", "text"), slots, default).select("qid", "id", "rank", "model_score")
    own = W.partitionBy("qid")
    good = F.col("model_score").isNotNull() if least is None else F.col("model_score") >= least
    s = s.withColumn("fell_back", F.max(F.col("model_score").isNull()).over(own) | ~F.max(F.coalesce(good, F.lit(False))).over(own))
    s = s.where(F.col("fell_back") | good)
    order = F.when(~F.col("fell_back"), -F.col("model_score"))
    return s.withColumn("pos", F.row_number().over(own.orderBy(order, "rank", "id"))).where(F.col("pos") <= k).select("qid", "id", "pos", "model_score", "fell_back")
