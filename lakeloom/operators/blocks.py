"""Cosines of many vectors with many others, block against block.

Both sides are cut into blocks by a hash, and each pair of blocks is a group of its own: one
product of matrices, strip by strip. That product only picks candidates, with a margin far above its error; their
cosines are then added up one dimension after another in double precision, as
``functions.vectors.cosine`` does, so results are equal to the last bit. A task holds two blocks
and a strip of their product, whatever the size of a group.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors of a block, and of one where all near pairs come back; rows of a strip, and pairs whose cosines are added up at once.
BLOCK, DENSE, STRIP, SLICE = 8192, 4096, 256, 1 << 18
#: Rounding to six digits joins cosines that are up to 1e-6 apart.
MARGIN = 2e-6


def _rows(side: DataFrame, group: list[str]) -> DataFrame:
    """side(id, v, group...) with the length of v; vectors without a cosine go."""
    v = F.col("v") if dict(side.dtypes)["v"] in ("array<float>", "array<double>") else F.col("v").cast("array<double>")
    return side.select(F.col("id").alias("id"), v.alias("v"), *[F.col(g).alias(g) for g in group]).where("size(v) > 0 AND NOT exists(v, x -> x IS NULL)").withColumn("dim", F.size("v"))


def _norms(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x))
    for c in x.T:
        s = s + c * c
    return np.sqrt(s)


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of x and j of y, added up from the first dimension on."""
    out = np.zeros(len(i))
    for at in range(0, len(i), SLICE):
        part = slice(at, at + SLICE)
        s = out[part]
        for c, d in zip(x.T, y.T, strict=True):
            s += c[i[part]] * d[j[part]]
    return out


def _first(i: np.ndarray, j: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Which pairs to keep so that of those of one row with one cosine the first k by j are there."""
    key = np.where(np.isnan(cos), np.nan, cos + 0.0).view(np.int64)
    order = np.lexsort((j, key, i))
    a, b = i[order], key[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    start = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    return np.sort(order[np.arange(len(a)) - start < k])


def _sorted(t: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Ids in their order, nulls first, and their vectors as rows of a matrix."""
    ids, v = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t.column("id"), t.column("v")))
    keys = ids.flatten() if pa.types.is_struct(ids.type) else [ids]
    names = [str(n) for n in range(len(keys))]
    order = pc.sort_indices(pa.table(keys, names), sort_keys=[(n, "ascending") for n in names], null_placement="at_start")
    x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
    return ids.take(order), x[order.to_numpy()]


def _compare(k: int | None, least: float | None, other: bool, within: bool):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (ids, x), (jds, y) = _sorted(left), _sorted(right)
        same = within and key[-2].as_py() == key[-1].as_py()
        if other:
            mine, its = ids.to_numpy(zero_copy_only=False), jds.to_numpy(zero_copy_only=False)
        out = []
        with np.errstate(all="ignore"):
            nx, ny = _norms(x), _norms(y)
            for at in range(0, len(x), STRIP):
                n = nx[at : at + STRIP, None] * ny[None, :]
                s = x[at : at + STRIP] @ y.T / n
                odd = ~np.isfinite(s) & ~(n <= 0)  # what overflowed or isn't a number is looked at in any case
                s[~np.isfinite(s) | (n <= 0)] = -np.inf
                if other:
                    equal = mine[at : at + STRIP, None] == its[None, :]
                    s[equal], odd[equal] = -np.inf, False
                bar = np.full(len(s), -2.0 if least is None else least - MARGIN)
                if k is not None and s.shape[1] > k:
                    bar = np.maximum(bar, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - MARGIN)
                keep = (s >= bar[:, None]) | odd
                if same:
                    keep &= np.arange(at, at + len(s))[:, None] < np.arange(s.shape[1])[None, :]
                i, j = np.nonzero(keep)
                i += at
                cos = _exact(x, y, i, j) / (nx[i] * ny[j])
                if k is not None and len(i):
                    few = _first(i, j, cos, k)
                    i, j, cos = i[few], j[few], cos[few]
                out.append(pa.table([ids.take(pa.array(i)), jds.take(pa.array(j)), pa.array(cos)], ["a", "b", "cos"]))
        return pa.concat_tables(out)

    return run


def _six(c: np.ndarray) -> np.ndarray:
    """Rounded to six digits as Spark's round does, halves of the shortest decimal away from zero."""
    m = np.abs(c) * 1e6
    out = np.floor(m + 0.5)
    for i in np.nonzero(np.abs(m - np.floor(m) - 0.5) < 1e-6)[0]:
        out[i] = int((Decimal(repr(float(abs(c[i])))) * 1000000).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(out / 1e6, c) + 0.0


def pair_hash(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(lo, hi) of longs."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(lo), 42, np.uint64)
    for part in (lo, hi):
        h = (h + p5 + np.uint64(8)) ^ (turn(part.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def _rank(k: int, least: float):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (ids, x), (jds, y) = ((t.to_numpy(zero_copy_only=False), v) for t, v in (_sorted(left), _sorted(right)))
        out = []
        with np.errstate(all="ignore"):
            nx, ny = _norms(x), _norms(y)
            for at in range(0, len(x), STRIP):
                n = nx[at : at + STRIP, None] * ny[None, :]
                s = x[at : at + STRIP] @ y.T / n
                odd = ~np.isfinite(s) & ~(n <= 0)
                s[~np.isfinite(s) | (n <= 0)] = -np.inf
                equal = ids[at : at + STRIP, None] == jds[None, :]
                s[equal], odd[equal] = -np.inf, False
                bar = np.full(len(s), least - MARGIN)
                if s.shape[1] > k:
                    bar = np.maximum(bar, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - MARGIN)
                i, j = np.nonzero((s >= bar[:, None]) | odd)
                i += at
                score = _six(_exact(x, y, i, j) / (nx[i] * ny[j]))
                near = ~(score < least)  # NaN is more than any number, and comes last
                i, j, score = i[near], j[near], score[near]
                lo, hi = np.minimum(ids[i], jds[j]), np.maximum(ids[i], jds[j])
                tie = pair_hash(lo, hi)
                order = np.lexsort((hi, lo, tie, -score, i))
                a = i[order]
                start = np.searchsorted(a, a)
                order = order[np.arange(len(a)) - start < k]
                out.append(pa.table({"a": ids[i[order]], "b": jds[j[order]], "score": score[order], "tie": tie[order]}))
        return pa.concat_tables(out)

    return run


def nearest_within(side: DataFrame, k: int, least: float, group: list[str]) -> DataFrame:
    """(a, b, place, last): of each id of side(id, v, group...) its k first others of equal groups by falling score, tie, ids.

    Score is the cosine to six digits, ``least`` or more; tie is xxhash64 of the two ids, the lesser first.
    Ids are longs; where b's id is repeated it has several places, of which the first and the last are given. Both ways round of a pair are looked at; what has no cosine is left out.
    """
    near = _blockwise(side, side, group, BLOCK, _rank(k, least), columns="a long, b long, score double, tie long")
    place = F.row_number().over(W.partitionBy("a").orderBy(-F.col("score"), "tie", F.least("a", "b"), F.greatest("a", "b")))
    return near.withColumn("place", place).where(F.col("place") <= k).groupBy("a", "b").agg(F.min("place").alias("place"), F.max("place").alias("last"))


def cosines(left: DataFrame, right: DataFrame, k: int | None = None, least: float | None = None, group: list[str] | None = None, other: bool = False) -> DataFrame:
    """(a, b, cos): ids of left(id, v, group...) and right(id, v, group...) with equal, not null groups, and their cosine.

    All pairs that may be, by cosine to six digits and then id b, among the k first of their a, and
    that may have a cosine of ``least`` or more; more may come, so rank and filter what is
    returned. ``other`` leaves out pairs of equal ids, which must not be null. Vectors that are null or zero or hold nulls
    have no cosine, nor have two of different length.
    """
    return _blockwise(left, right, group or [], BLOCK, _compare(k, least, other, False))


def cosines_within(side: DataFrame, least: float, group: list[str] | None = None) -> DataFrame:
    """(a, b, cos): every pair of rows of side(id, v, group...) once, either way round, that may have a cosine of ``least`` or more."""
    return _blockwise(side, side, group or [], DENSE, _compare(None, least, False, True), "a_block <= b_block")


def _blockwise(left: DataFrame, right: DataFrame, group: list[str], most: int, run, which: str = "true", columns: str | None = None) -> DataFrame:
    keys, blocks = [*group, "dim"], lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a, b = _rows(left, group), _rows(right, group)
    sizes = lambda s, n: s.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias(n))
    n = sizes(a, "na").join(sizes(b, "nb"), keys)
    at = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n))
    a = a.join(n, keys).withColumn("a_block", at("na")).withColumn("b_block", blocks("nb")).where(which)
    b = b.join(n, keys).withColumn("b_block", at("nb")).withColumn("a_block", blocks("na")).where(which)
    kinds = [dict(s.dtypes)["id"] for s in (a, b)]
    by = [*keys, "a_block", "b_block"]
    return a.select(*by, "id", "v").groupBy(*by).cogroup(b.select(*by, "id", "v").groupBy(*by)).applyInArrow(run, columns or f"a {kinds[0]}, b {kinds[1]}, cos double")
