"""Embedding whitening from bit-sliced cross-products.

Entries become integers. In each block of distinct vectors every dimension is shifted to start at
0 and cut into bit planes, whose bits are packed across rows into words; the popcounts of the AND
of two planes, weighted by their places, add up to the exact cross-product of two dimensions.
Sums and cross-products of all blocks meet as integers, are centred as integers, and only then
become the doubles that eigh takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.session import materialize

#: Vectors packed at once; a plane of them has a 64th as many words.
BLOCK_ROWS = 4096
#: Bits of a limb: sums over tasks are added limb by limb, so they stay exact whatever their size.
LIMB = 40


def integers(v: str | Column, scale: int = 256) -> Column:
    """Each entry c as floor(scale * c) in double precision; beyond 64 bits the nearest there is."""
    at = F.col(v) if isinstance(v, str) else v
    return F.transform(at.cast("array<double>"), lambda c: F.least(F.greatest(F.floor(c * scale), F.lit(-(2**63))), F.lit(2**63 - 1)).cast("long"))


def usable(v: str) -> Column:
    """Whether a vector has entries and all of them are finite."""
    return F.expr(f"`{v}` IS NOT NULL AND size(`{v}`) > 0 AND NOT exists(`{v}`, c -> c IS NULL OR isnan(c) OR abs(c) = double('infinity'))")


def limbs(total: int) -> list[int]:
    """total in base 2**LIMB, least first; the last one is signed."""
    out = []
    while not -(1 << LIMB) <= total < 1 << LIMB:
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums and, for i <= j, sums of products of the columns of an integer matrix, by bit planes."""
    n, d = x.shape
    low = x.min(0)
    u = x.view(np.uint64) - low.view(np.uint64)  # in 64 bits whatever the signs
    width = [max(1, int(m).bit_length()) for m in u.max(0)]
    bits = np.zeros((sum(width), -(-n // 64) * 64), bool)
    first = np.concatenate([[0], np.cumsum(width)])
    for j in range(d):
        for p in range(width[j]):
            bits[first[j] + p, :n] = u[:, j] >> np.uint64(p) & np.uint64(1)
    words = np.packbits(bits, axis=1).view(np.uint64)
    place = np.concatenate([np.arange(w) for w in width])
    ones = np.bitwise_count(words).sum(1, dtype=np.int64)
    shifted = [sum(int(ones[k]) << int(place[k]) for k in range(first[j], first[j + 1])) for j in range(d)]
    small = 2 * max(width) + int(n).bit_length() < 63  # then weighted counts fit 64 bits
    low_int, products = [int(v) for v in low], [[0] * d for _ in range(d)]
    for i in range(d):
        total = np.zeros(d - i, np.int64 if small else object)
        for p in range(width[i]):
            both = np.bitwise_count(words[first[i] : ] & words[first[i] + p]).sum(1, dtype=np.int64)
            weighted = (both if small else both.astype(object)) << (place[first[i] :] if small else place[first[i] :].astype(object))
            total = total + (np.add.reduceat(weighted, first[i:-1] - first[i]) << p)
        for j in range(i, d):
            products[i][j] = int(total[j - i]) + low_int[i] * shifted[j] + low_int[j] * shifted[i] + n * low_int[i] * low_int[j]
    return [s + n * m for s, m in zip(shifted, low_int, strict=True)], products


@dataclass
class Whitener:
    """n fit vectors with sums, the leading eigenvalues (falling), their unit vectors as columns, and the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Of each row of an integer matrix the exact deviation and the whitened components (nan where an eigenvalue is 0)."""
        most = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.sums))
        if len(self.sums) * most * most < 2**63:
            away = self.n * x - np.array(self.sums, np.int64)
            deviation = (away * away).sum(1).tolist()
        else:
            away = np.array([[self.n * int(c) - s for c, s in zip(row, self.sums, strict=True)] for row in x], object)
            deviation = [v if v < 2**63 else None for v in (sum(c * c for c in row) for row in away)]
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = np.where(self.values > 0, 1 / np.sqrt(np.maximum(self.values, 0)), np.nan)
        return deviation, (away.astype(float) / self.n) @ self.vectors * unit


def fit(x: DataFrame, components: int = 4) -> Whitener | None:
    """The whitener of x(x array<long>), all of one length and distinct; None for no rows. Only sums of all rows reach the driver."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products, waiting, rows = 0, None, None, [], 0

        def take(parts: list[np.ndarray]) -> None:
            nonlocal n, sums, products
            block = np.concatenate(parts)
            s, p = scatter(block)
            n += len(block)
            if sums is None:
                sums, products = s, p
            else:
                sums = [a + b for a, b in zip(sums, s, strict=True)]
                products = [[a + b for a, b in zip(q, r, strict=True)] for q, r in zip(products, p, strict=True)]

        for b in it:
            if b.num_rows:
                m = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                for k in range(0, len(m), BLOCK_ROWS):
                    waiting.append(m[k : k + BLOCK_ROWS])
                    rows += len(waiting[-1])
                    if rows >= BLOCK_ROWS:
                        take(waiting)
                        waiting, rows = [], 0
        if waiting:
            take(waiting)
        if sums is not None:
            d = len(sums)
            found = [(-1, -1, n), *((i, -1, s) for i, s in enumerate(sums)), *((i, j, products[i][j]) for i in range(d) for j in range(i, d))]
            flat = [(i, j, k, v) for i, j, total in found for k, v in enumerate(limbs(total))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "limb", "value"])

    parts = x.select("x").mapInArrow(add, "i int, j int, limb int, value long")
    totals: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).collect():  # a few rows for each pair of dimensions
        totals[r.i, r.j] = totals.get((r.i, r.j), 0) + (r.value << (LIMB * r.limb))
    if not totals:
        return None
    n, d = totals[-1, -1], max(i for i, _ in totals) + 1
    sums = [totals[i, -1] for i in range(d)]
    centred = [[n * totals[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    covariance = np.array([[c / (n * n) for c in row] for row in centred])  # one rounding for each entry
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    top = np.where(values[order] > values.max() * d * np.finfo(float).eps, values[order], 0.0)  # below that eigh tells nothing from 0
    return Whitener(n, sums, top, vectors[:, order], sum(centred[i][i] for i in range(d)) / (n * n))


def _apply(x: DataFrame, w: Whitener, keep: str, kind: str) -> DataFrame:
    """(keep, deviation, whitened array<double>) of x(keep, x)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                deviation, white = w.project(m)
                flat = pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, white.shape[1]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.int64()), lists], names=[keep, "deviation", "whitened"])

    return x.select(keep, "x").mapInArrow(run, f"`{keep}` {kind}, deviation long, whitened array<double>")


def whiten(rows: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """rows(vec_id, embedding, ...) -> vec_id, component, n, deviation, whitened, explained, identity_error.

    The model is fitted on the distinct integer vectors, so copies of a vector, however many,
    count once. Vectors that are null or empty or hold a null or non-finite entry are dropped, and
    so are those whose length isn't the commonest one (the greater, if two are equally common).
    Repeated rows and rows without an id are whitened like any other; other columns are ignored;
    an empty table, or one without usable vectors, gives no rows. A component whose eigenvalue is
    0 to double precision has a null whitened value and is left out of identity_error; explained
    is null if all vectors are the same. A deviation beyond 64 bits is null. There are as many
    components as dimensions if these are fewer than asked for.

    The driver gets sums over all rows for each pair of dimensions and nothing that grows with rows.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    good = rows.where(usable(vec_col)).select(F.col(id_col), integers(vec_col, scale).alias("x"))
    lengths = good.groupBy(F.size("x").alias("len")).count().orderBy(F.desc("count"), F.desc("len")).first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema)
    good = good.where(F.size("x") == lengths["len"])
    distinct = materialize(good.select("x").distinct(), "whitening-fit")
    w = fit(distinct, components)
    k = len(w.values)
    live = [c for c in range(k) if w.values[c] > 0]
    own = _apply(distinct.withColumn("one", F.lit(1)), w, "one", "int")
    cells = [(a, b) for a in live for b in live if a <= b]
    found = own.agg(F.count("*"), *[F.covar_pop(F.col("whitened")[a], F.col("whitened")[b]) for a, b in cells]).first()  # one row
    error = max((abs(v - (a == b)) for (a, b), v in zip(cells, found[1:], strict=True)), default=0.0)
    share = F.array(*[F.lit(float(v / w.trace) if w.trace > 0 else None).cast("double") for v in w.values])
    out = _apply(good, w, id_col, kind).select(id_col, "deviation", F.posexplode("whitened").alias("c", "white"))
    return out.select(
        id_col, (F.col("c") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", F.col("white").alias("whitened"),
        F.get(share, F.col("c")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
