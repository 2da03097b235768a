"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

Heuristic labellers vote good (1), bad (-1) or nothing (0) on a document. How often each votes
what on good and on bad documents is estimated by expectation-maximisation over the counts of
vote patterns of all documents. The posterior of a document's pattern is its soft label. A
linear model over hashed word shapes and statistics learns the soft labels of a bounded sample
and scores every document, also where no labeller speaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.hashing import chunks, mix, words
from lakeloom.session import discard, materialize

#: Hashed features of the scorer, and statistics the labellers vote on.
FEATURES = 2048
STATISTICS = ("symbols", "upper", "distinct", "marks", "length", "repeats", "bars", "words")
#: Labellers that know one kind of junk: they vote bad in the statistic's range, else nothing.
DETECTORS = (
    ("symbols", 0.25, np.inf), ("upper", 0.45, np.inf), ("distinct", 0.0, 0.35), ("marks", 0.15, np.inf),
    ("length", 14.0, np.inf), ("repeats", 0.2, np.inf), ("bars", 0.25, np.inf), ("words", 0.0, 1.0),
)
#: Labellers that know good text: they vote good if all statistics are in their ranges, else nothing. They overlap.
PROSE = (
    (("symbols", 0.0, 0.15), ("upper", 0.0, 0.3), ("marks", 0.0, 0.1), ("repeats", 0.0, 0.1), ("bars", 0.0, 0.1), ("words", 1.0, np.inf)),
    (("distinct", 0.4, 1.01), ("length", 2.0, 10.0), ("repeats", 0.0, 0.15), ("words", 1.0, np.inf)),
    (("length", 2.0, 10.0), ("marks", 0.0, 0.05), ("bars", 0.0, 0.05), ("upper", 0.0, 0.4), ("words", 5.0, np.inf)),
)
N_LABELLERS = len(DETECTORS) + len(PROSE)

_CLASS = np.arange(256, dtype=np.uint8)  # upper case X, other letters x, digits 9, the rest as they are
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 88, 120, 57, 120
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&<>"])
_MARK = np.isin(np.arange(256), [ord(c) for c in "!?#*$%&"])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text of a chunk: STATISTICS, and FEATURES of its word shapes and statistics."""
    n_texts = len(offsets) - 1
    starts, ends, h, text = words(data, offsets)
    n = np.bincount(text, minlength=n_texts).astype(float)
    size = np.concatenate([[0], np.cumsum(data[: len(data)] & 0xC0 != 0x80)])  # code points
    per = np.maximum(n, 1)

    def each(flag: np.ndarray) -> np.ndarray:
        """Bytes with the flag, by text."""
        c = np.concatenate([[0], np.cumsum(flag)])
        return (c[offsets[1:]] - c[offsets[:-1]]).astype(float)

    letters = np.maximum(each((_CLASS[data] == 88) | (_CLASS[data] == 120)), 1)
    pair = np.zeros(len(data), bool)
    pair[1:] = _MARK[data[1:]] & _MARK[data[:-1]]
    pair[offsets[:-1][offsets[:-1] < len(data)]] = False
    order = np.lexsort((h, text))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    stats = np.stack([
        each(_SYMBOL[data]) / per, each(_CLASS[data] == 88) / letters, np.bincount(text[order], new, n_texts) / per,
        each(pair) / per, np.bincount(text, size[ends] - size[starts], n_texts) / per, np.bincount(text, again, n_texts) / per,
        each(data == ord("|")) / per, n,
    ], axis=1)
    x = np.zeros((n_texts, FEATURES), np.float32)
    if len(h):
        cls = _CLASS[data]
        runs = np.ones(len(cls), bool)
        runs[1:] = cls[1:] != cls[:-1]
        runs[starts] = True
        place = np.cumsum(runs)
        first = place[starts] - 1  # runs before the word
        power = np.cumprod(np.full(64, np.uint64(0x100000001B3)), dtype=np.uint64)
        inside = np.zeros(len(cls), np.int64)
        owner = np.searchsorted(starts, np.arange(len(cls)), "right") - 1
        inside = np.minimum(np.maximum(place - 1 - first[np.maximum(owner, 0)], 0), 63)
        value = np.where(runs, mix(cls.astype(np.uint64) + np.uint64(1)) * power[inside], np.uint64(0))
        total = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
        shape = (mix(total[ends] - total[starts]) % np.uint64(FEATURES - 256)).astype(np.int64)
        count = np.bincount(text * FEATURES + shape, minlength=n_texts * FEATURES).reshape(n_texts, FEATURES)
        x += np.sqrt(count / per[:, None]).astype(np.float32)
    for j in range(len(STATISTICS) - 1):  # the last, length, says nothing of quality
        level = np.clip(np.rint(np.log2(stats[:, j] + 2**-8) * 2) + 16, 0, 31).astype(np.int64)
        x[np.arange(n_texts), FEATURES - 256 + j * 32 + level] = 1
    return stats, x


def votes(stats: np.ndarray) -> np.ndarray:
    """Texts by labellers: 1 good, -1 bad, 0 nothing."""

    def inside(name: str, low: float, high: float) -> np.ndarray:
        x = stats[:, STATISTICS.index(name)]
        return (x >= low) & (x < high)

    bad = [-inside(*d).astype(np.int8) for d in DETECTORS]
    return np.stack([*bad, *[np.all([inside(*r) for r in rule], axis=0).astype(np.int8) for rule in PROSE]], axis=1)


def _pattern(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> dict[int, float]:
    """Posterior of good by vote pattern.

    Each labeller has its own rates of good, bad and no vote on good and on bad documents.
    Kinds of junk are many and a labeller knows one of them, so the start holds for bad what any
    labeller calls bad; the rounds then weigh labellers that the others contradict.
    """
    v = patterns[:, None] // 3 ** np.arange(N_LABELLERS) % 3  # 0 bad, 1 nothing, 2 good
    good = np.where((v == 0).any(1), 0.05, 0.95)
    for _ in range(rounds):
        w = np.stack([counts * (1 - good), counts * good])
        prior = w.sum(1) / w.sum()
        log = np.log(np.maximum(prior, 1e-9))[:, None] + np.zeros((2, len(v)))
        for j in range(v.shape[1]):
            t = np.stack([np.bincount(v[:, j], w[y], 3) + 1 for y in (0, 1)])
            log += np.log(t / t.sum(1, keepdims=True))[:, v[:, j]]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    return dict(zip(patterns.tolist(), good.tolist(), strict=True))


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    w = v = np.zeros(x.shape[1], np.float32)
    step = np.float32(4 / max(1e-9, float((x * x).sum(1).max())))
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - step * ((x.T @ (p - y)) / len(x) + l2 * v)
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return w


def classify(docs: DataFrame, max_rows: int = 4000, least: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, p_weak (posterior of its votes), score, kept (score >= least), and the columns in keep.

    Labellers are fitted on the vote patterns of all documents (at most 3 ** labellers counts);
    the scorer on at most max_rows documents, those whose doc_id hashes lowest. Null and empty
    texts have no words, which a labeller calls bad, and are voted on and scored like any other; a
    table of such texts alone gives scores near 0. Repeated rows get equal scores; an empty table
    gives no rows.
    """
    rows = docs.select(F.coalesce(F.xxhash64(F.col("doc_id").cast("string")), F.lit(0)).alias("h"), "text")
    total = docs.count()
    cut = int(2**64 * min(1.0, 0.9 * max_rows / max(total, 1))) - 2**63

    def survey(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in it:
            low = b.column(0).to_numpy(zero_copy_only=False) < cut
            for first, end, data, offsets in chunks(b.column(1)):
                stats, x = features(data, offsets)
                ps = _pattern(votes(stats))
                for p, c in zip(*np.unique(ps, return_counts=True), strict=True):
                    seen[int(p)] = seen.get(int(p), 0) + int(c)
                at = np.nonzero(low[first:end])[0]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ps[at]), pa.nulls(len(at), pa.int64()), pa.array([x[i].astype(np.float16).tobytes() for i in at], pa.binary()), b.column(0).slice(first, end - first).take(pa.array(at))], names=["pattern", "n", "x", "h"])
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64()), pa.nulls(len(seen), pa.binary()), pa.nulls(len(seen), pa.int64())], names=["pattern", "n", "x", "h"])

    seen = materialize(rows.mapInArrow(survey, "pattern long, n long, x binary, h long"), "quality-survey")
    counts = seen.where("x IS NULL").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    sample = seen.where("x IS NOT NULL").select("h", "pattern", "x").orderBy("h", "pattern").limit(max_rows).collect()
    discard(seen)
    good: dict[int, float] = {}
    weights = np.zeros(FEATURES + 1, np.float32)
    if counts:
        good = fit_labellers(np.array([r.pattern for r in counts]), np.array([r.n for r in counts], float))
    if sample:
        x = np.stack([np.frombuffer(r.x, np.float16) for r in sample]).astype(np.float32)
        weights = fit_scorer(x, np.array([good[r.pattern] for r in sample], np.float32))
    carried = [c for c in (keep or []) if c not in ("doc_id", "text")]
    source = docs.select("doc_id", "text", *carried)
    types = {f.name: f.dataType.simpleString() for f in source.schema}

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            weak, scores = np.zeros(len(b)), np.zeros(len(b))
            for first, end, data, offsets in chunks(b.column(1)):
                stats, x = features(data, offsets)
                weak[first:end] = [good.get(int(p), 0.0) for p in _pattern(votes(stats))]
                scores[first:end] = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            scores = np.round(scores, 6)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weak), pa.array(scores), pa.array(scores >= least), *b.columns[2:]], names=["doc_id", "p_weak", "score", "kept", *carried])

    return source.mapInArrow(apply, f"doc_id {types['doc_id']}, p_weak double, score double, kept boolean" + "".join(f", `{c}` {types[c]}" for c in carried))
