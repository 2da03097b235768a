"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random onto eight dimensions, scaled, shifted and decoded to the
nearest point of the E8 lattice, in several tables. Each vector is stored under its own cell and
probes the neighbouring lattice cells nearest to its projection; what meets in a cell of its
label is verified by the cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.hashing import mix
from lakeloom.plans.components import connected_components
from lakeloom.session import materialize


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the offsets of a cell's neighbours."""
    out = []
    for i, j in combinations(range(8), 2):
        for a in (1, -1):
            for b in (1, -1):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    for bits in range(256):
        if bin(bits).count("1") % 2 == 0:
            out.append(np.array([0.5 - (bits >> k & 1) for k in range(8)]))
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    r = np.rint(x)
    odd = r.sum(1).astype(np.int64) % 2 != 0
    d = x - r
    k = np.abs(d).argmax(1)
    rows = np.nonzero(odd)[0]
    r[rows, k[rows]] += np.where(d[rows, k[rows]] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 = D8 and D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(near[:, None], a, b)


class Lattice:
    """tables random projections of dim dimensions, drawn from seed alone."""

    def __init__(self, dim: int, tables: int, width: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.maps = [rng.standard_normal((dim, 8)) / width for _ in range(tables)]
        self.shifts = [rng.random(8) for _ in range(tables)]
        self.roots = roots()

    def cells(self, unit: np.ndarray, probes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each table and probe the rows' cell hashes and whether it is their own cell."""
        for t, (m, s) in enumerate(zip(self.maps, self.shifts, strict=True)):
            x = unit @ m + s
            own = nearest_e8(x)
            away = x - own
            gain = away @ self.roots.T  # the largest inner products are the nearest neighbours
            order = np.argpartition(-gain, min(probes, 239), axis=1)[:, :probes]
            for k in range(-1, probes):
                c = own if k < 0 else own + self.roots[order[:, k]]
                h = np.full(len(c), np.uint64(t + 1))
                for j in range(8):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.rint(2 * c[:, j]).astype(np.int64).view(np.uint64))
                yield h, k < 0


def near_duplicates(vectors: DataFrame, least: float = 0.98, tables: int = 6, probes: int = 6, width: float = 0.7, seed: int = 20240731, part_rows: int = 512) -> DataFrame:
    """vectors(vec_id, embedding, label, ...) -> vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null, they meet in a cell of some table,
    and their cosine is at least ``least``; the tables, probes and width (of a cell, against
    vectors of length 1) set the share of such pairs that meet. Vectors that are null, zero, of
    another length than their partner or hold a null or non-finite component link with nothing.
    Equal vectors of a label are one throughout, with a count, so that copies cost no pairs.
    n_links counts other vectors linked directly, copies included; component_id is the least
    vec_id reachable, kept whether it is the row's own. Repeated rows count as further vectors;
    an empty table gives no rows.
    """
    e = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    fine = F.expr("v IS NOT NULL AND label IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)")
    e = e.withColumn("key", F.when(fine, F.struct("label", F.sha2(F.array_join("v", ","), 256).alias("h"))))
    e = materialize(e.select("vec_id", "key", F.when(fine, F.col("v")).alias("v")), "vectors")
    one = e.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    one = materialize(one.select("rep", "copies", F.col("key.label").alias("label"), "key", "v"), "distinct-vectors")

    def cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices: dict[int, Lattice] = {}
        for b in it:
            flat, at = b.column(1).flatten().to_numpy(zero_copy_only=False), b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(at)
            for dim in np.unique(at):
                rows = np.nonzero(at == dim)[0]
                x = np.stack([flat[ends[i] - dim : ends[i]] for i in rows])
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                if dim not in lattices:
                    lattices[dim] = Lattice(int(dim), tables, width, seed)
                ids = b.column(0).take(pa.array(rows))
                for h, own in lattices[dim].cells(x, probes):
                    yield pa.RecordBatch.from_arrays([ids, b.column(2).take(pa.array(rows)), pa.array((h ^ np.uint64(dim)).view(np.int64)), pa.array(np.full(len(rows), own))], names=["rep", "label", "cell", "own"])

    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    hashed = one.select("rep", "v", "label").mapInArrow(cells, f"rep {id_type}, label {label_type}, cell long, own boolean")
    hashed = materialize(hashed, "lattice-cells")
    stored = hashed.where("own").select("label", "cell", F.col("rep").alias("b"))
    pairs = hashed.select("label", "cell", F.col("rep").alias("a")).join(stored, ["label", "cell"]).where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    norm = "sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"
    unit = one.select("rep", F.expr(f"transform(v, x -> x / array_max(transform(v, y -> abs(y))))").alias("v"))
    unit = unit.select("rep", "v", F.expr(norm).alias("norm"))
    both = pairs.join(unit.select(F.col("rep").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na")), "a")
    both = both.join(unit.select(F.col("rep").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb")), "b")
    dot = F.expr("aggregate(zip_with(va, vb, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    links = both.where(F.expr("size(va) = size(vb)")).where(dot / (F.col("na") * F.col("nb")) >= least).select("a", "b")
    links = materialize(links, "vector-links")

    copies = one.select("rep", "copies")
    each = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = each.join(copies.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    parts = connected_components(links)
    known = one.select("rep", "copies", "key").join(linked.withColumnRenamed("a", "rep"), "rep", "left")
    known = known.join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"), F.coalesce("component", "rep").alias("component"))
    out = e.select("vec_id", "key").join(known, "key", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
