"""Words of text that is written without spaces: a vocabulary learned from the corpus, and the best path through it."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.text import CJK
from lakeloom.session import materialize

#: Runs that are cut; the rest is split at white space.
CJK_RUN = f"[{CJK}]+"


def _entropy(side: str, grams: DataFrame) -> DataFrame:
    """(gram, n, entropy) of the characters on one side of each gram, in nats; the end of a run is a character of its own."""
    pairs = grams.groupBy("gram", side).agg(F.count("*").alias("c"))
    g = pairs.groupBy("gram").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("s"))
    return g.select("gram", "n", (F.log(F.col("n").cast("double")) - F.col("s") / F.col("n")).alias("entropy"))


def learn_words(docs: DataFrame, text: Column, run: str = CJK_RUN, max_len: int = 4, min_count: int = 5, min_entropy: float = 0.7, min_cohesion: float = 1.0, most: int = 100_000, simplified: dict[str, str] | None = None) -> DataFrame:
    """(word, n, logp): the characters of all runs and the longer strings that behave like words.

    A string of 2 to max_len characters is a word if it occurs min_count times, what stands on its
    left and on its right is uncertain (the lesser branching entropy is min_entropy or more), and
    no cut of it explains how often it occurs (the least pointwise mutual information of its two
    parts is min_cohesion or more). logp is the log of its share of all single characters. The
    ``most`` words of highest count are kept, ties by word, so the vocabulary fits a task.
    simplified maps characters to others first. Null texts and texts without runs add nothing.
    """
    if simplified:
        text = F.translate(text, "".join(simplified), "".join(simplified.values()))
    runs = docs.select(F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({run})"))).alias("r"))
    at = runs.select("r", F.explode(F.sequence(F.lit(1), F.length("r"))).alias("i"))
    at = at.select("r", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_len), F.length("r") - F.col("i") + 1))).alias("k"))
    piece = lambda a, n: F.substring("r", a, n)
    grams = at.select(piece(F.col("i"), F.col("k")).alias("gram"), F.when(F.col("i") > 1, piece(F.col("i") - 1, F.lit(1))).otherwise("").alias("left"), piece(F.col("i") + F.col("k"), F.lit(1)).alias("right"))
    left, right = _entropy("left", grams), _entropy("right", grams).select("gram", F.col("entropy").alias("other"))
    seen = materialize(left.join(right, "gram").select("gram", "n", F.least("entropy", "other").alias("entropy")), "grams")
    total = seen.where(F.length("gram") == 1).agg(F.sum("n").alias("total"))
    long = seen.where((F.length("gram") > 1) & (F.col("n") >= min_count) & (F.col("entropy") >= min_entropy))
    cuts = long.select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k"))
    cuts = cuts.select("gram", "n", F.substring("gram", F.lit(1), F.col("k")).alias("a"), F.expr("substring(gram, k + 1)").alias("b"))
    part = lambda c: seen.select(F.col("gram").alias(c), F.col("n").alias(f"n{c}"))
    cuts = cuts.join(part("a"), "a").join(part("b"), "b").crossJoin(F.broadcast(total))  # one row
    log = lambda c: F.log(F.col(c).cast("double"))
    good = cuts.groupBy("gram", "n").agg(F.min(log("n") + log("total") - log("na") - log("nb")).alias("cohesion")).where(F.col("cohesion") >= min_cohesion)
    words = seen.where(F.length("gram") == 1).select("gram", "n").unionByName(good.select("gram", "n"))
    kept = words.orderBy(F.desc("n"), "gram").limit(most).crossJoin(F.broadcast(total))  # one row
    return kept.select(F.col("gram").alias("word"), "n", (log("n") - log("total")).alias("logp"))


def best_path(run: str, logp: dict[str, float], max_len: int, floor: float) -> list[str]:
    """The words of highest total logp; a character that is no word costs floor. Of equal paths that with the longer last word."""
    score, back = [0.0], [0]
    for i in range(1, len(run) + 1):
        best, at = -math.inf, i - 1
        for j in range(max(0, i - max_len), i):
            p = logp.get(run[j:i], floor if j == i - 1 else None)
            if p is not None and score[j] + p > best:
                best, at = score[j] + p, j
        score.append(best)
        back.append(at)
    out, i = [], len(run)
    while i:
        out.append(run[back[i] : i])
        i = back[i]
    return out[::-1]


def segmenter(vocabulary: DataFrame, run: str = CJK_RUN, simplified: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """A function from text to tokens: runs cut along their best path, the rest split at white space, in order.

    It can stand wherever a tokenizer can, for one in the full-text search. The vocabulary (bounded
    by learn_words) goes to every task. Null texts have no tokens.
    """
    logp = {r.word: r.logp for r in vocabulary.select("word", "logp").collect()}
    longest, floor = max(map(len, logp), default=1), min(logp.values(), default=0.0) - math.log(2)
    find, table = re.compile(f"({run})"), str.maketrans(simplified or {})

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            out: list[str] = []
            for n, part in enumerate(find.split((text or "").translate(table))):
                out += best_path(part, logp, longest, floor) if n % 2 else part.split()
            return out

        return texts.map(one)

    return cut
