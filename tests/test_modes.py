"""Modes, upkeep and reply parsing on small rows: edges that the registered queries do not reach."""

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import records as rec
from lakeloom.operators import modes as M
from lakeloom.operators import tables as T
from lakeloom.operators import upkeep as U
from lakeloom.session import shared_dir
from lakeloom.sources.writers import upsert


def test_rerank_without_scores_keeps_the_order(spark):
    hits = spark.createDataFrame([(1, 10, 1, None), (1, 11, 2, None), (2, 10, 1, 0.1), (2, 11, 2, 0.9), (2, 12, 3, None)], "qid long, id long, rank int, s double")
    got = lambda least: sorted((r.qid, r.pos, r.id) for r in M.rerank(hits, F.col("s"), 3, least).collect())
    assert got(None) == [(1, 1, 10), (1, 2, 11), (2, 1, 11), (2, 2, 10), (2, 3, 12)]
    assert got(0.5) == [(1, 1, 10), (1, 2, 11), (2, 1, 11)]


def test_multi_hop_stops(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "a long, b long")
    hop = lambda ids: links.join(ids.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id"))
    start = spark.createDataFrame([(1,), (1,)], "id long")
    assert sorted(map(tuple, M.multi_hop(start, hop, 10).collect())) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert M.multi_hop(start, hop, 10, lambda seen: seen.count() >= 2).count() == 2
    assert M.multi_hop(start.limit(0), hop).count() == 0


def test_pick_chunks_falls_back_to_polling(spark):
    chunks = spark.createDataFrame([(g, r, g * 10 + r) for g in range(2) for r in range(1, 5)], "grp long, rn long, chunk_id long")
    scores = chunks.select("chunk_id", (F.col("chunk_id") / 100).alias("score"))
    assert [r.chunk_id for r in M.pick_chunks(chunks, scores, 2, 3).orderBy("pos").collect()] == [14, 13, 12]
    fallback = M.pick_chunks(chunks, scores.where("chunk_id <> 14"), 2, 3)
    assert {r.chunk_id for r in fallback.collect()} == {1, 2, 3, 11}
    assert M.pick_chunks(chunks.limit(0), scores, 0).count() == 0


def test_tuple_records_of_odd_replies(spark):
    rows = [(1, None), (2, ""), (3, "no records"), (4, '("entity"<|>A B<|>Person<|>who)##("relationship"<|>A<|>A<|>self<|>k<|>2)##("relationship"<|>A<|>C<|>knows<|>k<|>much)<|COMPLETE|>')]
    df = spark.createDataFrame(rows, "id int, t string").select("id", rec.entity_records(F.col("t")).alias("e"), rec.relation_records(F.col("t")).alias("r"))
    got = {r.id: ([tuple(x) for x in r.e], [tuple(x) for x in r.r]) for r in df.collect()}
    assert got == {1: ([], []), 2: ([], []), 3: ([], []), 4: ([("A B", "person", "who")], [("A", "C", "k", "knows", 1.0)])}


def test_final_answer_and_paths(spark):
    df = spark.createDataFrame([("x Final Answer: a Final Answer:  b ",), ("  plain ",), ("  ",), (None,)], "t string")
    assert [r.a for r in df.select(rec.final_answer(F.col("t")).alias("a")).collect()] == ["b", "plain", None, None]
    paths = spark.createDataFrame([("a/b.md",), ("../b.md",), ("/b.md",), ("a/../b.md",), ("a\\b.md",), ("a/.md",), ("b.txt",), (None,)], "p string")
    assert [r.v for r in paths.select(rec.valid_page_path(F.col("p")).alias("v")).collect()] == [True] + [False] * 7


def test_fold_batches_and_converged(spark):
    df = spark.createDataFrame([(1, []), (2, [1, 2, 3, 4, 5])], "id int, v array<int>")
    f = U.fold_batches(F.col("v"), 2, lambda acc, b: F.concat(acc, F.array(F.size(b))), F.array().cast("array<int>"))
    assert [r.f for r in df.orderBy("id").select(f.alias("f")).collect()] == [[], [2, 2, 1]]
    assert U.converged(0, 0) and U.converged(100, 96) and not U.converged(100, 95)


def test_tree_with_orphans_and_depth(spark):
    nodes = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "lost", "X")], "id string, parent string, name string")
    assert sorted((r.id, r.depth, tuple(r.path)) for r in U.flatten_tree(nodes, 1).collect()) == [("a", 0, ("A",)), ("b", 1, ("A", "B"))]
    tree = {tuple(r.path): r.children for r in U.assemble_tree(U.flatten_tree(nodes)).collect()}
    assert tree == {("A",): ["B"], ("A", "B"): ["C"], ("A", "B", "C"): []}


def test_upsert_ties_and_fan_out(spark):
    rows = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (1, 4, 9, "c")], "k int, version int, id int, v string")
    assert [r.v for r in upsert(rows.limit(0), rows, ["k"], "version", "id").collect()] == ["b"]
    with pytest.raises(ValueError):
        T.fan_out(spark, "DROP TABLE {table}", {"a": rows})
    assert T.fan_out(spark, "SELECT max(v) AS m FROM {table}", {"a": rows, "b": rows.drop("v")}).collect() == [("a", "c")]


def test_shared_dir_is_named_or_local(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == named.rstrip("/") if named else shared_dir(spark).startswith("file:")
