"""Cosines block by block against those of all pairs, with blocks so small that many meet."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.functions.vectors import cosine
from lakeloom.operators import blocks, dedup, memory_modes, retrieval, upkeep


@pytest.fixture
def rows(spark, monkeypatch):
    """Vectors with exact and near copies, nulls, zeros, holes, other lengths, infinite entries and repeated ids, in two groups and none."""
    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(blocks, "DENSE", 16)
    monkeypatch.setattr(blocks, "STRIP", 5)
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(60)]
    rows = [(i, v, i % 2) for i, v in enumerate(base)]
    rows += [(100 + i, base[7], 1) for i in range(25)] + [(200 + i, [x + rng.gauss(0, 1e-7) for x in base[8]], 0) for i in range(25)]
    odd = [None, [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [2.0, 1.0], [], [float("inf"), 1.0, 0.0, 0.0, 0.0, 0.0], [1e-200] * 6, [1e200] * 6]
    rows += [(300 + i, v, 1) for i, v in enumerate(odd)] + [(3, base[4], 1), (5, base[5], 1), (400, base[7], None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def crossed(df, group):
    left = df.select("label", F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    right = df.select(F.col("label").alias("l2"), F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    p = left.crossJoin(right).where("label = l2" if group else "true").select("a", "b", F.round(cosine("va", "vb"), 6).alias("s"))
    return sorted(((r.a, r.b, r.s) for r in p.where("s IS NOT NULL").collect()), key=lambda r: (r[0], -np.inf if np.isnan(r[2]) else -r[2], r[1]))


def text(rows):
    return sorted(map(str, rows))


def first(pairs, k, **at):
    return [r for _, g in itertools.groupby(pairs, key=lambda r: r[0]) for r in list(g)[:k]]


@pytest.mark.parametrize("group", ["label", None])
def test_top_k_of_many_queries(rows, group):
    q = rows.where("vec_id % 3 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), "label")
    q = q.where("vec_id <> 3")
    got = retrieval.vector_top_k_batch(rows, q if group else q.drop("label"), 4, group).collect()
    want = first([p for p in crossed(rows, group) if p[0] % 3 == 0 and p[0] != 3], 4)
    assert text((r.qid, r.vec_id, r.score) for r in got) == text(want) and len(want) > 100


def test_pairs_and_best_of_each(rows):
    pairs = [p for p in crossed(rows, True) if np.isnan(p[2]) or p[2] >= 0.3]
    assert text(map(tuple, dedup.similar_pairs(rows, "label", 0.3).select("a", "b", "score").collect())) == text(p for p in pairs if p[0] < p[1])
    want = first([p for p in pairs if p[0] != p[1]], 5)
    assert text(map(tuple, dedup.similar_pairs(rows, "label", 0.3, 5).select("a", "b", "score").collect())) == text(want)


def test_matches_and_memory_hits(rows):
    new = rows.where("vec_id < 40 AND vec_id NOT IN (3, 5)").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    old = rows.where("vec_id >= 40 AND vec_id < 300").select(F.col("vec_id").alias("match"), F.col("embedding").alias("w"), "label")
    some = lambda group: [p for p in crossed(rows.where("vec_id NOT IN (3, 5)"), group) if p[0] < 40 <= p[1] < 300 and p[2] >= 0.2]
    assert text(map(tuple, upkeep.best_matches(new, old, 0.2, "label").collect())) == text(first(some(True), 1))
    items = old.select(F.struct((F.col("match") % 4).alias("a"), F.col("match").alias("b")).alias("id"), F.col("w").alias("v"))
    got = memory_modes.nearest(new.select(F.col("id").alias("qid"), "v"), items, 3, 0.2).collect()
    by = sorted(some(False), key=lambda p: (p[0], -p[2], p[1] % 4, p[1]))
    assert text((r.qid, r.id.b) for r in got) == text((a, b) for a, b, _ in first(by, 3))


def test_a_task_gets_two_blocks(spark, monkeypatch):
    """However many rows a group has: the all-pairs join sent a group's rows to one task."""
    monkeypatch.setattr(blocks, "DENSE", 50)
    seen = []
    monkeypatch.setattr(blocks, "_blockwise", lambda *a, real=blocks._blockwise: seen.append(a[3]) or real(*a))
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"), F.lit(1).alias("label"))
    want = sum(np.cos(i - j) >= 0.9 for i in range(400) for j in range(i + 1, 400))
    assert dedup.similar_pairs(df, "label", 0.9).count() == want and seen == [50]


def test_best_match_compares_blocks(rows, spark, monkeypatch, tmp_path):
    """w11 crossed each query with its whole label in expressions; queries without any cosine keep their row."""
    from lakeloom import catalog

    more = [(500, [0.0] * 6, 7), (501, [1.0] * 6, 7), (600, [1.0] * 6, 8), (700, [0.0] * 6, None)]
    rows = rows.where("vec_id <> 300").unionByName(spark.createDataFrame(more, rows.schema))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    q = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), "label")
    p = rows.join(q, "label").where("qid <> vec_id").select("qid", "vec_id", F.round(cosine("embedding", "q"), 6).alias("score"))
    want = p.groupBy("qid").agg(F.max_by(F.struct("vec_id", "score"), F.struct(F.col("score"), -F.col("vec_id"))).alias("b")).select("qid", "b.vec_id", "b.score")
    seen = []
    monkeypatch.setattr(blocks, "_blockwise", lambda *a, real=blocks._blockwise, **k: seen.append(a[3]) or real(*a, **k))
    got = catalog.QUERIES["w11_best_match"](spark, str(tmp_path)).collect()
    assert text(map(tuple, got)) == text(map(tuple, want.collect())) and seen == [16]
    assert {r.qid: (r.vec_id, r.score) for r in got}[500] == (501, None)
