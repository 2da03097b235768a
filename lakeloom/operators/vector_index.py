"""An inverted-file vector index with product-quantised codes, for inner products.

Vectors get one more coordinate that makes all of them equally long, so the largest inner product
is the nearest vector. Coarse centroids cut the space into lists; what is left of a vector beside
its centroid is coded by one codeword for each of several groups of coordinates. A search reads
the codes of the lists nearest to a query, takes the candidates with the best estimate, and scores
these exactly. Centroids and codewords are fitted on a bounded sample; every row is indexed.

Below the index's folder lie ``model`` (centroids and codewords), ``stats`` (rows and radius of
each list, by batch), ``codes`` and ``vectors`` (by batch and list). A batch that is inserted again
replaces itself, so a writer that died can start over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.vectors import inner_product, norm
from lakeloom.session import materialize

#: Rows that centroids and codewords are fitted on, those of least hash.
TRAIN_ROWS = 50_000
#: Lists at most: their centroids are held by each task.
MOST_LISTS = 4096
#: Codes and queries that one group of a search holds.
SEGMENT_ROWS, QUERY_ROWS = 16_384, 512
#: Half a unit of the sixth digit, to which scores are rounded, with room for the estimate's own rounding.
SLACK = 2e-6


@dataclass
class Model:
    """dim coordinates; length that all vectors are brought to; centroids (lists x dim + 1); words (groups x codes x width)."""

    dim: int
    length: float
    centroids: np.ndarray
    words: np.ndarray

    def longer(self, x: np.ndarray) -> np.ndarray:
        """x with the coordinate that completes its length; 0 for one that is longer than any the model was fitted on."""
        missing = np.sqrt(np.maximum(self.length**2 - (x * x).sum(1), 0))
        return np.concatenate([x, missing[:, None]], 1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each vector its list, its code, how far the coded vector is off, and how far the centroid is (in dim coordinates)."""
        y = self.longer(x)
        near = nearest(y, self.centroids)
        rest = y - self.centroids[near]
        parts = split(rest, self.words.shape[0])
        code = np.stack([nearest(parts[:, g], w) for g, w in enumerate(self.words)], 1).astype(np.uint8)
        coded = np.concatenate([w[code[:, g]] for g, w in enumerate(self.words)], 1)[:, : self.dim]
        off = rest[:, : self.dim]
        return near, code, np.sqrt(((off - coded) ** 2).sum(1)), np.sqrt((off * off).sum(1))

    def estimates(self, at: int, q: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Inner products of queries with the coded vectors of a list."""
        parts = split(np.concatenate([q, np.zeros((len(q), 1))], 1), self.words.shape[0])
        out = np.repeat((q @ self.centroids[at, : self.dim])[:, None], len(code), 1)
        for g, w in enumerate(self.words):
            out += (parts[:, g] @ w.T)[:, code[:, g]]
        return out


def split(x: np.ndarray, groups: int) -> np.ndarray:
    """rows x groups x width, with zeros behind the last coordinate."""
    width = -(-x.shape[1] // groups)
    return np.pad(x, ((0, 0), (0, groups * width - x.shape[1]))).reshape(len(x), groups, width)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The index of each row's nearest center, the first of equal ones."""
    return ((centers * centers).sum(1) - 2 * (x @ centers.T)).argmin(1)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)


def _lloyd(points: DataFrame, groups: int, k: int, first: np.ndarray, rounds: int) -> np.ndarray:
    """k-means of points(x array<double>) in each group of coordinates at once; a job a round, sums of codes come back."""
    centers = first

    for _ in range(rounds):

        def sums(it: Iterator[pa.RecordBatch], now: np.ndarray = centers) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(now.shape), np.zeros(now.shape[:2], np.int64)
            for b in it:
                if b.num_rows:
                    parts = split(matrix(b.column(0), len(b.column(0).flatten()) // b.num_rows), groups)
                    for g in range(groups):
                        at = nearest(parts[:, g], now[g])
                        np.add.at(total[g], at, parts[:, g])
                        count[g] += np.bincount(at, minlength=k)
            g, c = np.nonzero(count)
            found = np.concatenate([total[g, c], count[g, c][:, None]], 1)  # the count comes behind the sums
            at, i = np.divmod(np.arange(found.size), found.shape[1]) if found.size else (np.zeros(0, int), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (g[at], c[at], i)] + [pa.array(found.ravel())], names=["g", "c", "i", "v"])

        rows = points.mapInArrow(sums, "g int, c int, i int, v double").groupBy("g", "c", "i").agg(F.sum("v").alias("v")).toPandas()  # a few for each code
        full = np.zeros((*centers.shape[:2], centers.shape[2] + 1))
        full[rows["g"], rows["c"], rows["i"]] = rows["v"]
        new = np.where(full[:, :, -1:] > 0, full[:, :, :-1] / np.maximum(full[:, :, -1:], 1), centers)
        if np.allclose(new, centers, rtol=0, atol=1e-9):
            break
        centers = new
    return centers


def _usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> DataFrame:
    """(id, v array<double>) of the vectors that have entries, all finite, and dim of them."""
    v = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = v.where("v IS NOT NULL AND size(v) > 0 AND NOT exists(v, c -> c IS NULL OR isnan(c) OR abs(c) = double('infinity'))")
    return v if dim is None else v.where(F.size("v") == dim)


class VectorIndex:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/model").collect()  # centroids and codewords: bounded by MOST_LISTS
        of = {k: sorted((r for r in rows if r.kind == k), key=lambda r: (r.g, r.c)) for k in ("centroid", "word", "shape")}
        dim, groups = int(of["shape"][0].v[0]), 1 + max(r.g for r in of["word"])
        words = np.array([r.v for r in of["word"]]).reshape(groups, -1, len(of["word"][0].v))
        self.model = Model(dim, of["shape"][0].v[1], np.array([r.v for r in of["centroid"]]), words)

    @classmethod
    def train(cls, spark: SparkSession, path: str, vectors: DataFrame, lists: int | None = None, groups: int = 16, codes: int = 256, rounds: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> VectorIndex:
        """Fit and write an empty index. lists is by default the root of the number of rows, MOST_LISTS at most.

        The sample is the TRAIN_ROWS rows of least hash of their id, so it depends on no order. Its
        dimension is the commonest one; vectors of another are not indexed.
        """
        v = _usable(vectors, id_col, vec_col)
        shape = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm("v")).alias("longest")).orderBy(F.desc("n"), F.desc("dim")).first()
        if shape is None:
            raise ValueError("no vector to fit an index on")
        lists = max(1, min(lists or round(math.sqrt(shape.n)), MOST_LISTS, shape.n))
        model = Model(shape.dim, shape.longest, np.zeros((1, shape.dim + 1)), np.zeros((groups, 1, 1)))
        sample = v.where(F.size("v") == shape.dim).orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)

        def lengthen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(list(model.longer(matrix(b.column(1), model.dim))), pa.list_(pa.float64()))], names=["id", "x"])

        points = materialize(sample.repartition(spark.sparkContext.defaultParallelism, "id").mapInArrow(lengthen, "id string, x array<double>"), "index-sample")
        seeds = np.array([r.x for r in points.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(max(lists, codes)).collect()])  # seeds only
        model.centroids = _lloyd(points.select("x"), 1, lists, seeds[None, :lists], rounds)[0]

        def remains(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                if b.num_rows:
                    x = matrix(b.column(0), model.dim + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(list(x - model.centroids[nearest(x, model.centroids)]), pa.list_(pa.float64()))], names=["x"])

        codes = min(codes, len(seeds))
        first = split(seeds - model.centroids[nearest(seeds, model.centroids)], groups)[:codes].transpose(1, 0, 2)
        model.words = _lloyd(points.select("x").mapInArrow(remains, "x array<double>"), groups, codes, np.ascontiguousarray(first), rounds)
        rows = [("shape", 0, 0, [float(model.dim), float(model.length)])]
        rows += [("centroid", 0, c, v.tolist()) for c, v in enumerate(model.centroids)]
        rows += [("word", g, c, v.tolist()) for g, ws in enumerate(model.words) for c, v in enumerate(ws)]
        spark.createDataFrame(rows, "kind string, g int, c int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        return cls(spark, path)

    def insert(self, vectors: DataFrame, batch: int = 0, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        """Add every usable vector to the list of its nearest centroid. Ids should be new; nothing is fitted again."""
        model, kind = self.model, vectors.schema[id_col].dataType.simpleString()

        def code(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                if b.num_rows:
                    near, code, off, away = model.encode(matrix(b.column(1), model.dim))
                    cells = [b.column(0), b.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(off), pa.array(away), pa.array(near.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cells, names=["id", "v", "code", "off", "away", "list"])

        coded = materialize(_usable(vectors, id_col, vec_col, model.dim).mapInArrow(code, f"id {kind}, v array<double>, code binary, off double, away double, list int"), "index-batch")
        stats = coded.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
        stats.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/batch={batch}")  # first: a radius too large does no harm
        spread = coded.hint("rebalance", "list")  # a large list is written by several tasks, small ones share one
        for name, columns in (("vectors", ["id", "v"]), ("codes", ["id", "code", "off"])):
            spread.select("list", *columns).sortWithinPartitions("list", "id").write.mode("overwrite").partitionBy("list").parquet(f"{self.path}/{name}/batch={batch}")

    def _table(self, name: str, columns: str) -> DataFrame:
        return self.spark.read.schema(f"{columns}, list int, batch int").option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def stats(self) -> DataFrame:
        """(list, n, radius) of the lists that hold anything."""
        s = self.spark.read.schema("list int, n long, radius double, batch int").parquet(f"{self.path}/stats")
        return s.groupBy("list").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))

    def _id_type(self) -> str:
        return self.spark.read.parquet(f"{self.path}/vectors").schema["id"].dataType.simpleString()

    def _probes(self, queries: DataFrame, nprobe: int | None) -> DataFrame:
        """(qid, q, list) for the nprobe lists nearest to each query; with None for all whose bound reaches the query's ``least``."""
        model, stats = self.model, {r.list: r.radius for r in self.stats().collect()}  # at most MOST_LISTS
        held = np.array(sorted(stats), np.int64)
        radius = np.array([stats[k] for k in held.tolist()])
        kind = queries.schema["qid"].dataType.simpleString()

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                if b.num_rows and len(held):
                    q = matrix(b.column(1), model.dim)
                    c = model.centroids[held]
                    if nprobe is None:
                        best = q @ c[:, : model.dim].T + np.sqrt((q * q).sum(1))[:, None] * radius
                        rows, cols = np.nonzero(best >= b.column(2).to_numpy()[:, None] - SLACK)
                    else:
                        far = (c * c).sum(1) - 2 * (q @ c[:, : model.dim].T)
                        cols = np.argsort(far, axis=1, kind="stable")[:, :nprobe].ravel()
                        rows = np.repeat(np.arange(len(q)), min(nprobe, len(held)))
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(held[cols].astype(np.int32))], names=["qid", "q", "least", "list"])

        return queries.select("qid", "q", "least").mapInArrow(run, f"qid {kind}, q array<double>, least double, list int")

    def _candidates(self, probes: DataFrame, most: int | None) -> DataFrame:
        """(qid, list, id, guess): by estimates from codes, the best ``most`` of each group, or all that may reach ``least``.

        A group is a segment of a list with a block of the queries that probe it; both are bounded,
        so neither a large list nor a popular one is one task.
        """
        model, qid, key = self.model, probes.schema["qid"].dataType.simpleString(), self._id_type()
        asked = probes.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
        plan = self.stats().select("list", F.ceil(F.col("n") / SEGMENT_ROWS).cast("int").alias("segments")).join(asked, "list")  # a row a list
        hashed = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        codes = self._table("codes", f"id {key}, code binary, off double").drop("batch").join(F.broadcast(plan), "list")  # MOST_LISTS rows at most
        codes = codes.withColumn("segment", hashed("id", "segments")).withColumn("block", each("blocks")).select("list", "segment", "block", "id", "code", "off")
        p = probes.join(F.broadcast(plan), "list")  # as above
        p = p.withColumn("block", hashed("qid", "blocks")).withColumn("segment", each("segments")).select("list", "segment", "block", "qid", "q", "least")

        def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(left) and len(right):
                code = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1)
                off, ids = left["off"].to_numpy(), left["id"].to_numpy()
                for k in range(0, len(right), 64):
                    some = right.iloc[k : k + 64]
                    q = np.stack(some["q"].to_numpy())
                    guess = model.estimates(int(key[0]), q, code)
                    if most is None:
                        rows, cols = np.nonzero(guess + np.sqrt((q * q).sum(1))[:, None] * off >= some["least"].to_numpy()[:, None] - SLACK)
                    else:
                        n = min(most, len(left))
                        cols = np.argpartition(-guess, n - 1, axis=1)[:, :n].ravel()
                        rows = np.repeat(np.arange(len(q)), n)
                    out.append(pd.DataFrame({"qid": some["qid"].to_numpy()[rows], "list": int(key[0]), "id": ids[cols], "guess": guess[rows, cols]}))
            return pd.concat(out) if out else pd.DataFrame({"qid": [], "list": [], "id": [], "guess": []})

        group = ["list", "segment", "block"]
        return codes.groupBy(*group).cogroup(p.groupBy(*group)).applyInPandas(run, f"qid {qid}, list int, id {key}, guess double")

    def _score(self, found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """Exact scores of candidates, the k best of each query. The candidates choose the lists that are read."""
        vectors = self._table("vectors", f"id {self._id_type()}, v array<double>").select("list", "id", "v")
        scored = vectors.join(found, ["list", "id"]).join(queries.select("qid", "q"), "qid")
        scored = scored.select("qid", "id", F.round(inner_product("v", "q"), 6).alias("score"))
        best = W.partitionBy("qid").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int, nprobe: int = 128, keep: int | None = None, exact: bool = False) -> DataFrame:
        """(qid, id, score, rank): for queries(qid, q) the k largest inner products, rounded to six digits; ties by id.

        nprobe lists are read for each query, and the keep (by default 10 k, at least 200)
        candidates of best estimate scored. With exact, the k-th score of that first pass is then a
        bound: every list whose centroid and radius can't rule it out is read, and every vector
        whose estimate and coding error can't, is scored. The result is that of a full scan.
        Queries with a null or non-finite entry, or of another dimension, give no rows.
        """
        keep = keep or max(10 * k, 200)
        q = _usable(queries, "qid", "q", self.model.dim).select(F.col("id").alias("qid"), F.col("v").alias("q"), F.lit(float("-inf")).alias("least"))
        q = materialize(q, "index-queries")
        found = self._candidates(self._probes(q, nprobe), keep)
        nearest_first = W.partitionBy("qid").orderBy(F.desc("guess"), "id")
        found = found.withColumn("_n", F.row_number().over(nearest_first)).where(F.col("_n") <= keep).select("qid", "list", "id")
        hits = self._score(found, q, k)
        if not exact:
            return hits
        bound = hits.where(F.col("rank") == k).select("qid", F.col("score").alias("kth"))
        q = materialize(q.join(bound, "qid", "left").select("qid", "q", F.coalesce("kth", F.lit(float("-inf"))).alias("least")), "index-queries")
        return self._score(self._candidates(self._probes(q, None), None).select("qid", "list", "id"), q, k)

    def tune(self, queries: DataFrame, k: int, recall: float = 0.95, most: int = 200) -> int:
        """The least nprobe whose lists hold that share of the true k nearest of queries(qid, q), of which ``most`` of least hash are tried.

        Searches these exactly and looks at which place each true hit's list comes for its query.
        The more alike all distances are, the more lists that takes.
        """
        model, held = self.model, np.array(sorted(r.list for r in self.stats().collect()), np.int64)  # at most MOST_LISTS
        some = materialize(queries.select("qid", "q").orderBy(F.xxhash64("qid"), "qid").limit(most), "index-tuning")
        hits = self.search(some, k, nprobe=max(1, len(held) // 8), exact=True).select("qid", "id")
        lists = self._table("codes", f"id {self._id_type()}, code binary, off double").select("id", "list")
        met = lists.join(hits, "id").join(some.select("qid", F.col("q").cast("array<double>").alias("q")), "qid").select("q", "list")

        def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = model.centroids[held]
            for b in it:
                if b.num_rows:
                    q = matrix(b.column(0), model.dim)
                    far = (c * c).sum(1) - 2 * (q @ c[:, : model.dim].T)
                    at = np.searchsorted(held, b.column(1).to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array((far < far[np.arange(len(q)), at][:, None]).sum(1) + 1, pa.int64())], names=["place"])

        places = np.sort(np.array([r.place for r in met.mapInArrow(place, "place long").collect()], np.int64))  # k for each query tried
        return int(places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)]) if len(places) else max(1, len(held))

    def scanned_share(self, queries: DataFrame, nprobe: int) -> float:
        """The part of all codes that a query reads with nprobe lists, on average."""
        s = self.stats()
        q = _usable(queries, "qid", "q", self.model.dim).select(F.col("id").alias("qid"), F.col("v").alias("q"), F.lit(0.0).alias("least"))
        read = self._probes(q, nprobe).join(F.broadcast(s), "list").agg(F.sum("n").alias("n"), F.count_distinct("qid").alias("q")).first()  # one row a list
        total = s.agg(F.sum("n")).first()[0]
        return (read.n or 0) / (total * read.q) if read.q else 0.0
