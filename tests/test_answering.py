"""Ways to an answer on small tables: fused lists, stages asked in turn, tables filled by search."""

import uuid

import pytest
from pyspark.sql import functions as F

from lakeloom.operators.answering import Stage, ask_in_turn, document_answers, filled_table, fused
from lakeloom.operators.model_slots import Slot
from lakeloom.operators.text_index import TextIndex
from lakeloom.session import shared_dir
from lakeloom.sources.writers import export_table


def test_fused_with_mentions(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "qid long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "qid long, id long, rank int")
    m = spark.createDataFrame([(1, 12, 3)], "qid long, id long, n int")
    got = {(r.qid, r.id): r.score for r in fused([a, b], m).collect()}
    assert got == {(1, 10): round(1 / 61, 8), (1, 11): round(1 / 62 + 1 / 61, 8), (1, 12): 0.05, (2, 10): round(1 / 61, 8)}


def test_document_answers_order_and_fallback(spark):
    q = spark.createDataFrame([(1, "len", "q"), (2, "bad", None), (3, "len", "none")], "qid long, mode string, query string")
    hits = spark.createDataFrame([(k, i, i) for k in (1, 2) for i in (1, 2, 3, 4)], "qid long, id long, rank int")
    texts = spark.createDataFrame([(1, "a"), (2, "abc"), (3, "ab"), (4, None)], "id long, text string")

    def bad():
        raise RuntimeError("no model")

    slots = {"len": Slot(lambda: lambda pairs: [float(len(t)) for _, t in pairs]), "bad": Slot(bad)}
    got = sorted((r.qid, r.pos, r.id, r.fell_back) for r in document_answers(q, [hits], None, texts, 2, slots).collect())
    assert got == [(1, 1, 2, False), (1, 2, 3, False), (2, 1, 1, True), (2, 2, 2, True)]
    assert document_answers(q, [hits.limit(0)], None, texts, 2, slots).count() == 0


def test_stages_see_only_open_questions(spark):
    asked = []

    def stage(name, rows):
        def ask(q):
            asked.append((name, sorted(r.qid for r in q.collect())))
            return spark.createDataFrame(rows, "qid long, answer string, ok boolean")

        return Stage(name, ask, F.col("ok"))

    q = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, "z"), (None, "n"), (4, None)], "qid long, query string")
    one = stage("one", [(1, "b", True), (1, "a", True), (2, "c", False), (3, None, True), (4, "d", None), (9, "not asked", True)])
    two = stage("two", [(1, "late", True), (2, "e", True)])
    got = sorted(map(tuple, ask_in_turn(q, [one, two]).collect()))
    assert got == [(1, "one", "a", 1), (2, "two", "e", 2), (3, None, None, 2), (4, None, None, 2)]
    assert asked == [("one", [1, 2, 3, 4]), ("two", [2, 3, 4])]


def test_filled_table(spark):
    docs = spark.createDataFrame([(1, "size of ada in 2001 is 3 million"), (2, "size of bob in 2001 is large"), (3, None), (4, "size of ada in 2002 is")], "id long, text string")
    index = TextIndex(spark, f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}", 2)
    index.insert(docs, id_col="id")
    grid = spark.createDataFrame([(i, e, t, "size") for i, (e, t) in enumerate([("ada", "2001"), ("ada", "2002"), ("bob", "2001"), ("cy", "2001")])], "task_id long, entity string, time string, metric string")
    table = filled_table(index, docs, grid, F.concat_ws(" ", "metric", "entity", "time"), F.regexp_extract("text", " is (.*)$", 1), ["size"])
    assert sorted((r.entity, r.time, None if r["size"] is None else float(r["size"])) for r in table.collect()) == [("ada", "2001", 3e6), ("ada", "2002", None), ("bob", "2001", None), ("cy", "2001", None)]


@pytest.mark.parametrize("kind", ["csv", "md", "txt"])
def test_exports_are_one_text_in_order(spark, kind):
    df = spark.createDataFrame([(f"n{i:03}", 'a "b", c' if i == 7 else None if i == 8 else f"x|{i}\ny") for i in range(300)], "name string, note string").repartition(7)
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    export_table(df, path, kind, "name")
    files = spark.sparkContext.wholeTextFiles(path).collect()
    text = "".join(t for _, t in sorted(files))
    if kind == "csv":
        assert text.startswith('name,note\nn000,"x|0\ny"\n') and text.count("name,note\n") == 1 and "n008,\n" in text
        assert '\nn007,"a \\"b\\", c"\n' in text
    elif kind == "md":
        lines = text.splitlines()
        assert lines[:3] == ["| name | note |", "| --- | --- |", "| n000 | x\\|0 y |"] and len(lines) == 302 and lines[2:] == sorted(lines[2:])
    else:
        assert text.startswith("name: n000\nnote: x|0 y\n\nname: n001\n") and text.count("name: ") == 300
    empty = f"{path}-empty"
    export_table(df.limit(0), empty, kind, "name")
    assert spark.read.text(empty).count() == {"csv": 1, "md": 2, "txt": 0}[kind]
