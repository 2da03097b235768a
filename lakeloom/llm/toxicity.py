"""Toxicity: a chain of linear classifiers over categories.

Categories are predicted one after another. The model of each category sees the words of the
text and the probabilities of the categories before it; in training those probabilities are
out-of-fold, so that a later model learns from predictions as good as those it meets later.

The labels hold one flag, toxic. The chain's first two categories are derived from it and from
the terms that toxic documents favour: ``insult`` (toxic, with such a term) and ``barrage``
(toxic, with several); the last is ``toxic`` itself and decides. No feature counts those terms, so
how many there are reaches the last model through the earlier probabilities. Terms are words and
beginnings of words; those of a fold's models are chosen without the fold's labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.hashing import trim
from lakeloom.session import discard, materialize

CATEGORIES = ("insult", "barrage", "toxic")
_TERM = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> set[str]:
    """Distinct lower-cased runs of letters of a text, and of those of five or more the first four, with a star."""
    words = set(_TERM.findall(text.lower())) if text else set()
    return words | {w[:4] + "*" for w in words if len(w) > 4}


@dataclass
class Chain:
    """terms: index of each term; weights: for each category those of terms, earlier categories, bias."""

    terms: dict[str, int]
    weights: list[np.ndarray]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """x: rows by terms; probabilities, rows by categories."""
        p = np.zeros((len(x), 0))
        for w in self.weights:
            p = np.column_stack([p, _sigmoid(_with(x, p) @ w)])
        return p

    def rows(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.terms)), np.float32)
        for i, t in enumerate(texts):
            for w in self.terms.keys() & terms_of(t):
                x[i, self.terms[w]] = 1
        return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _with(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.column_stack([x, p, np.ones(len(x))])


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column of x is the bias and is hardly shrunk."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def categories(x: np.ndarray, y: np.ndarray, abusive: list[int]) -> list[np.ndarray]:
    """The labels of CATEGORIES, from the flag y and the number of abusive terms."""
    hits = x[:, abusive].sum(1)
    return [y * (hits >= 1), y * (hits >= 2), y]


@dataclass
class View:
    """The columns of x that one selection of terms has, and which of these are abusive."""

    columns: list[int]
    abusive: list[int]


def fit_chain(x: np.ndarray, y: np.ndarray, folds: np.ndarray, names: list[str], whole: View, without: dict[int, View]) -> Chain:
    """Category by category: out-of-fold probabilities for the later ones, then the model over all rows.

    x: rows by all selected terms, named by names. A fold's probabilities come from models of the
    other folds' rows over the terms (and categories) that these rows alone select.
    """
    weights: list[np.ndarray] = []
    p = np.zeros((len(x), 0))
    targets = {f: categories(x[:, v.columns], y, v.abusive) for f, v in without.items()}
    for k, target in enumerate(categories(x[:, whole.columns], y, whole.abusive)):
        held = np.full(len(x), float(target.mean()) if len(y) else 0.0)
        for f, v in without.items():
            inside = folds != f
            if inside.any() and not inside.all():
                z = _with(x[:, v.columns], p)
                held[~inside] = _sigmoid(z[~inside] @ fit_logistic(z[inside], targets[f][k][inside]))
        weights.append(fit_logistic(_with(x[:, whole.columns], p), target))
        p = np.column_stack([p, held])
    return Chain({names[c]: i for i, c in enumerate(whole.columns)}, weights)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_terms: int = 256, n_folds: int = 5) -> Chain | None:
    """Fits the chain on at most max_rows labelled documents, those whose doc_id hashes lowest.

    Terms are the max_terms words or beginnings that mark toxic documents most surely (log odds ratio
    less twice its standard error, with at least three documents), found by a distributed count,
    once over all rows and once without each fold. Rare terms of toxic documents alone so come
    before common words of a language that has more of them. Repeated rows of an id weigh as further rows and share its fold. Rows with a
    null id, label or text are left out. None if no row is left or all have one label.
    """
    picked = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id").agg(F.max("toxic").alias("y"))
        .withColumn("h", F.xxhash64("doc_id"))
        .orderBy("h", "doc_id").limit(max_rows)
    )

    def words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([sorted(terms_of(t)) for t in b.column(2).to_pylist()], pa.list_(pa.string()))],
                names=["h", "y", "words"],
            )

    rows = (
        docs.select("doc_id", "text").where("text IS NOT NULL")
        .join(F.broadcast(picked), "doc_id")  # at most max_rows ids
        .select("h", F.col("y").cast("int").alias("y"), "text")
        .mapInArrow(words, "h long, y int, words array<string>")
    )
    rows = materialize(rows, "toxicity-rows")
    fold = F.pmod("h", F.lit(n_folds)).cast("int")
    views = [None, *range(n_folds)]
    in_view = {v: F.lit(True) if v is None else fold != v for v in views}
    total = rows.agg(*[F.coalesce(F.sum(F.when(c, F.col("y") if k else 1 - F.col("y"))), F.lit(0)).alias(f"n{k}_{v}") for v, c in in_view.items() for k in (0, 1)]).first()
    n = {v: (total[f"n1_{v}"], total[f"n0_{v}"]) for v in views}  # of y and of 1 - y
    if not all(n[None]):
        return None
    counts = rows.select(F.explode("words").alias("word"), "y", fold.alias("fold")).groupBy("word", "fold").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    counts = counts.groupBy("word").agg(*[F.sum(F.when(F.lit(True) if v is None else F.col("fold") != v, F.col(c))).alias(f"{c}_{v}") for v in views for c in "ab"])
    counts = materialize(counts.where("a_None + b_None >= 3"), "toxicity-terms")
    chosen: dict = {}
    for v in views:  # one small job each
        a, b = F.coalesce(f"a_{v}", F.lit(0)) + 0.5, F.coalesce(f"b_{v}", F.lit(0)) + 0.5
        odds = F.log(a / (n[v][0] + 1 - a)) - F.log(b / (n[v][1] + 1 - b))
        ranked = counts.where(a + b >= 4).select("word", (odds - 2 * F.sqrt(1 / a + 1 / b)).alias("z")).orderBy(F.desc("z"), "word").limit(max_terms).collect()
        chosen[v] = {r.word: r.z for r in ranked}
    names = sorted(set().union(*chosen.values()))
    at = {w: i for i, w in enumerate(names)}
    kept = F.array_intersect("words", F.array(*[F.lit(t) for t in names])) if names else F.array()
    sample = rows.select("h", "y", kept.alias("words")).collect()  # max_rows rows of the selected words
    discard(counts, rows)
    sample.sort(key=lambda r: (r.h, r.y, r.words))
    x, y = np.zeros((len(sample), len(names)), np.float32), np.array([r.y for r in sample], float)
    for i, r in enumerate(sample):
        x[i, [at[w] for w in r.words]] = 1
    of = {v: View([at[w] for w in sorted(c)], [i for i, w in enumerate(sorted(c)) if c[w] > 1]) for v, c in chosen.items()}
    return fit_chain(x, y, np.array([r.h % n_folds for r in sample]), names, of.pop(None), of)


def classify(docs: DataFrame, chain: Chain | None, threshold: float = 0.5, with_row: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, p_insult, p_barrage, p_toxic, toxic, kept, and with_row all of docs as the struct row.

    toxic: p_toxic >= threshold; kept is its contrary. Whole texts are read, in one pass without
    a shuffle. A null or empty text has no terms and gets the chain's probabilities for none;
    without a chain (no usable labels) the probabilities are null and every document is kept.
    Repeated rows give repeated rows; an empty table gives none.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if with_row else []
    rows = docs.select("doc_id", "text", *[F.col(f"`{c}`") for c in others])
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    probs = [f"p_{c}" for c in CATEGORIES]
    schema = ", ".join([f"doc_id {types['doc_id']}", *[f"{p} double" for p in probs], "toxic boolean, kept boolean"])
    if with_row:
        schema += ", row struct<" + ", ".join(f"`{c}`: {t}" for c, t in types.items()) + ">"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if chain is None:
                p, toxic = [pa.nulls(len(b), pa.float64()) for _ in probs], np.zeros(len(b), bool)
            else:
                got = chain.predict(chain.rows(b.column(1).to_pylist()))
                p, toxic = [pa.array(c) for c in got.T], got[:, -1] >= threshold
            cols = [b.column(0), *p, pa.array(toxic), pa.array(~toxic)]
            cols += [pa.StructArray.from_arrays(b.columns, names=list(types))] if with_row else []
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *probs, "toxic", "kept", *["row"] * with_row])
        trim()

    return rows.mapInArrow(run, schema)
