"""Stored structures against brute force: the vector index, re-chunking, keyed tables, incremental entities and graphs."""

import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom import catalog
from lakeloom.operators import rechunking
from lakeloom.operators.chunking import window_spans
from lakeloom.operators.entity_merge import EntityStore
from lakeloom.operators.graph_store import GraphStore
from lakeloom.operators.retrieval import bm25
from lakeloom.operators.scans import overlapping, prefix_sums
from lakeloom.operators.text_index import TextIndex
from lakeloom.operators.vector_index import VectorIndex, split
from lakeloom.session import children
from lakeloom.sources.keyed import KeyedTable, logged


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


# --- vector index


def vectors(spark, n=2500, d=20, seed=1, first=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(25, d))
    x = centers[rng.integers(0, 25, n)] + rng.normal(size=(n, d)) * 0.35
    x *= rng.uniform(0.5, 2, (n, 1))  # lengths differ: the largest inner product isn't the nearest direction
    rows = [(first + i, [float(c) for c in v]) for i, v in enumerate(x)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def best(rows, q, k):
    scores = sorted((-round(float(np.dot(np.array(v), np.array(q))), 6), i) for i, v in rows)[:k]
    return [i for _, i in scores]


def test_index_recall_and_exact_search(spark, folder):
    rows, df = vectors(spark)
    index = VectorIndex.train(spark, folder, df, groups=8)
    index.insert(df)
    queries = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    share = index.scanned_share(queries, 10)
    assert len(index.model.centroids) == 50 and 0.05 < share < 0.4
    want = {i: best(rows, v, 10) for i, v in rows if i % 100 == 0}
    found = lambda hits: {i: [r.id for r in sorted(hits, key=lambda r: r.rank) if r.qid == i] for i in want}
    near = found(index.search(queries, 10, nprobe=10).collect())
    assert np.mean([len(set(near[i]) & set(want[i])) / 10 for i in want]) >= 0.9
    assert found(index.search(queries, 10, nprobe=2, keep=20, exact=True).collect()) == want


def test_query_of_the_index_reaches_its_recall(spark):
    """The registered query on the supplied table, whose vectors are nearly as far from each other as random ones."""
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = catalog.QUERIES["j9_index_topk"](spark, folder).collect()
    want = {i: set(best(rows, v, 10)) for i, v in rows if i % 100 == 0}
    assert sum(r.id in want[r.qid] for r in got) >= 0.9 * sum(map(len, want.values())) and {r.qid for r in got} == set(want)
    assert all(r.score == round(float(np.dot(np.array(dict(rows)[r.qid]), np.array(dict(rows)[r.id]))), 6) for r in got)


def test_index_takes_batches_without_training(spark, folder):
    """New rows, longer ones than any the index was fitted on, join their lists; a batch that is written twice counts once."""
    rows, df = vectors(spark, 600)
    more, df2 = vectors(spark, 300, seed=7, first=1000)
    more = [(i, [3 * c for c in v]) for i, v in more]
    index = VectorIndex.train(spark, folder, df, lists=12, groups=4, codes=32)
    index.insert(df, 0)
    odd = spark.createDataFrame([(5000, None), (5001, [1.0]), (5002, [float("nan")] * 20), (None, [1.0] * 20)], "vec_id long, embedding array<double>")
    for _ in range(2):
        index.insert(spark.createDataFrame(more, "vec_id long, embedding array<double>").unionByName(odd), 1)
    again = VectorIndex(spark, folder)
    assert again.stats().agg(F.sum("n")).first()[0] == 900
    queries = spark.createDataFrame([(1, more[3][1], "x"), (2, rows[5][1], "x"), (3, None, "x"), (4, [1.0], "x")], "qid long, q array<double>, score string")
    hits = again.search(queries, 7, nprobe=3, exact=True).collect()
    every = rows + more
    assert {i: [r.id for r in sorted(hits, key=lambda r: r.rank) if r.qid == i] for i in (1, 2)} == {1: best(every, more[3][1], 7), 2: best(every, rows[5][1], 7)}
    assert {r.qid for r in hits} == {1, 2} and again.search(queries.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        VectorIndex.train(spark, folder + "x", odd.limit(1))


def test_estimates_are_products_with_coded_vectors(spark, folder):
    rows, df = vectors(spark, 400, d=9)
    m = VectorIndex.train(spark, folder, df, lists=5, groups=4, codes=16, rounds=3).model
    x = np.array([v for _, v in rows])
    near, code, off, away = m.encode(x)
    coded = np.concatenate([w[code[:, g]] for g, w in enumerate(m.words)], 1)[:, :9] + m.centroids[near, :9]
    assert np.allclose(off, np.sqrt(((x - coded) ** 2).sum(1))) and np.allclose(away, np.sqrt(((x - m.centroids[near, :9]) ** 2).sum(1)))
    for at in range(5):
        mine = near == at
        assert np.allclose(m.estimates(at, x[:7], code[mine]), x[:7] @ coded[mine].T)
    assert split(np.ones((2, 10)), 4).shape == (2, 4, 3)


def test_text_index_equals_the_scan(spark, folder):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(300)] + [(300, None), (301, "W1 w1, w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = TextIndex(spark, folder, 8)
    for batch in (0, 1, 2, 1):
        index.insert(df.where(F.col("doc_id") % 3 == batch), batch)
    index.insert(spark.createDataFrame([(None, "w1")], "doc_id long, text string"), 3)
    queries = {1: ["w1", "w2", "w2"], 2: ["w3"], 3: ["nowhere"], 4: [f"w{i}" for i in range(8)]}
    asked = spark.createDataFrame([(q, w) for q, ws in queries.items() for w in ws] + [(5, None)], "qid int, term string")
    for pushed in (200, 3):
        got = {(r.qid, r.id): (r.score, r.matched) for r in index.search(asked, most_pushed=pushed).collect()}
        for q, ws in queries.items():
            assert {i: v for (n, i), v in got.items() if n == q} == {r.doc_id: (r.score, r.matched) for r in bm25(df, ws).collect()}
    both = index.search(asked, all_terms=True).where("qid = 1").collect()
    assert {r.id for r in both} == {r.doc_id for r in bm25(df, ["w1", "w2"], all_terms=True).collect()}
    top = index.search(asked, 3).where("qid = 4").orderBy("rank").collect()
    assert [r.id for r in top] == [r.doc_id for r in bm25(df, queries[4]).orderBy(F.desc("score"), "doc_id").limit(3).collect()]
    plan = index.search(asked.where("qid = 2"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [" in plan and "In(term" in plan or "EqualTo(term,w3)" in plan


# --- re-chunking


FIND = re.compile(rechunking.TOKEN).findall


def rechunk_by_hand(rows, size, overlap):
    """One stream a source, cut by the rule for single documents."""
    out = []
    for source in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == source and r[3]], key=lambda r: r[1])
        stream, ranges = [], []
        for _, _, cid, text, origin in mine:
            ranges.append((len(stream), len(stream) + len(FIND(text)), origin or [str(cid)]))
            stream += FIND(text)
        for text, a, b in window_spans(stream, size, overlap):
            out.append((source, a, b, text.strip(" \t\n\x0b\x0c\r"), sorted({x for s, e, o in ranges if e > a and s < b for x in o})))
    return sorted(out, key=str)


@pytest.mark.parametrize("size, overlap", [(16, 3), (7, 1), (40, 25)])
def test_rechunk(spark, monkeypatch, size, overlap):
    """Windows that cross rows, bins, blocks and groups of blocks; hot and null sources, empty and null texts."""
    monkeypatch.setattr(rechunking, "BIN_TOKENS", 41)
    monkeypatch.setattr(rechunking, "BLOCK_BINS", 2)
    monkeypatch.setattr(rechunking, "FAN", 3)
    rng = random.Random(size)
    rows = []
    for i in range(140):
        n = rng.choice([0, 1, 3, 10, 60, 200])
        text = "".join(rng.choice(["ab", "c,d", "e.", "世界。", "f"]) + rng.choice([" ", "\n", "  "]) for _ in range(n)) if n else rng.choice(["", None])
        rows.append((rng.choice(["hot", "hot", "hot", None, "b", "c]"]), i, i, (" " if i % 9 == 0 else "") + text if text else text, [f"o{i}", f"p{i // 2}"] if i % 3 == 0 else None))
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "source string, ord long, chunk_id long, text string, source_chunk array<string>, s string, e int, bin int").repartition(4)
    got = rechunking.rechunk(df, size, overlap).collect()
    assert sorted([(r.source, r.token_start, r.token_end, r.text, r.source_chunk) for r in got], key=str) == rechunk_by_hand(rows, size, overlap)
    assert rechunking.rechunk(df.limit(0), size, overlap).count() == 0


def test_overlapping_ranges_meet_once(spark):
    rng = random.Random(2)
    make = lambda k, n: [(rng.choice("ab"), i + k, s := rng.randrange(300), s + rng.randrange(60)) for i in range(n)]
    new, old = make(0, 80), make(1000, 120)
    got = overlapping(spark.createDataFrame(new, "source string, n int, s int, e int"), spark.createDataFrame(old, "source string, o int, os int, oe int"), 13)
    want = sorted((g, n, o) for g, n, s, e in new for h, o, a, b in old if g == h and b > s and a < e)
    assert sorted((r.source, r.n, r.o) for r in got.collect()) == want


def test_prefix_sums(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a"] * 6 + ["b", None]), rng.randrange(10**9), rng.randrange(9)) for _ in range(700)]
    got = prefix_sums(spark.createDataFrame(rows, "g string, o long, v long").repartition(7), "g", ["o"], F.col("v")).collect()
    want = []
    for g in {r[0] for r in rows}:
        mine, before = sorted(r for r in rows if r[0] == g), 0
        for pos, (_, o, v) in enumerate(mine):
            want.append((g, o, v, pos, before, sum(r[2] for r in mine)))
            before += v
    assert sorted([(r.g, r.o, r.v, r.pos, r.before, r.total) for r in got], key=str) == sorted(want, key=str)


# --- keyed tables


def test_keyed_table(spark, folder):
    t = KeyedTable(spark, folder, "k string, v long", ["k"], 8)
    change = lambda rows: spark.createDataFrame(rows, "k string, v long, gone boolean")
    rows = lambda version=None: sorted((r.k, r.v) for r in t.read(version=version).collect())
    assert rows() == [] and t.versions() == [] and t.replace(change([])) == 0
    first = [(f"k{i}", i, False) for i in range(60)] + [("k1", 100, False)]
    assert t.replace(change(first), "one") == 8 and t.replace(change(first), "one") == 0
    assert rows() == sorted((k, v) for k, v, _ in first)
    hit = t.replace(change([("k1", 7, False), ("k2", None, True), ("new", 5, False)]), "two")
    assert hit <= 3 and rows() == sorted([(k, v) for k, v, _ in first if k not in ("k1", "k2")] + [("k1", 7), ("new", 5)])
    assert [r.v for r in t.lookup(spark.createDataFrame([("k1",), ("k9",), ("nope",)], "k string")).orderBy("v").collect()] == [7, 9]
    assert rows(1) == sorted((k, v) for k, v, _ in first)
    t.restore(1)
    assert rows() == rows(1)
    t.replace(change([(k, None, True) for k, _, _ in first]))
    assert rows() == [] and len(t.versions()) == 4
    t.vacuum(2)
    assert t.versions() == [3, 4] and rows() == [] and rows(3) == sorted((k, v) for k, v, _ in first)


def test_changes_are_computed_once(spark, folder):
    """A batch that dies while its changes are written finds them anew; one that dies later doesn't."""
    calls = []

    def compute(fail):
        calls.append(fail)
        yield_ = {"a": spark.createDataFrame([(len(calls),)], "n int")}
        if fail:
            yield_["b"] = spark.range(1).select(F.raise_error(F.lit("dies")).cast("int").alias("n"))
        return yield_

    with pytest.raises(Exception, match="dies"):
        logged(spark, folder, "t", lambda: compute(True))
    for _ in range(2):
        assert {n: df.first()[0] for n, df in logged(spark, folder, "t", lambda: compute(False)).items()} == {"a": 2}
    assert calls == [True, False]


# --- entities batch by batch


def entities(store):
    return sorted((r.label, r.description, tuple(r.chunk_ids), r.records) for r in store.entities.read().collect())


def test_batches_of_entities_equal_one(spark, folder):
    rng = random.Random(9)
    records = [(f"n{rng.randrange(40)}", rng.choice(["d", "long text", None, "other text"]) , rng.choice([None, [f"c{k}"], [f"c{k}", "c0"]])) for k in range(120)]
    aliases = [(f"n{rng.randrange(40)}", f"n{rng.randrange(44)}") for _ in range(22)] + [(None, "n1"), ("n2", None), ("n3", "n3")]
    frames = lambda r, a: (spark.createDataFrame(r, "name string, description string, chunk_ids array<string>"), spark.createDataFrame(a, "a string, b string"))
    whole, parts = EntityStore(spark, folder + "/whole", 8), EntityStore(spark, folder + "/parts", 8)
    whole.merge(*frames([*records, (None, "x", None)], aliases), 0)
    for k in range(3):
        batch = frames(records[k::3], aliases[k::3])
        if k == 1:  # dies after one of three tables: the rest follows from the changes that were found before
            replace, KeyedTable.replace = KeyedTable.replace, lambda self, *a: (_ for _ in ()).throw(OSError("dies")) if self.path.endswith("members") else replace(self, *a)
            try:
                with pytest.raises(OSError):
                    parts.merge(*batch, k)
            finally:
                KeyedTable.replace = replace
        parts.merge(*batch, k)
        assert parts.merge(*batch, k) == {"labels": 0, "members": 0, "entities": 0}
    assert entities(parts) == entities(whole)
    by = lambda s: sorted((r.label, r.name) for r in s.members.read().collect())
    assert by(parts) == by(whole) == sorted((r.label, r.name) for r in parts.labels.read().collect())
    root = {f"n{i}": f"n{i}" for i in range(44)}
    for _ in range(44):
        for a, b in aliases:
            if a and b:
                root[a] = root[b] = min(root[a], root[b])
    named = {r[0] for r in records} | {x for a, b in aliases if a and b for x in (a, b)}
    assert dict((n, g) for g, n in by(whole)) == {n: root[n] for n in named}


def test_small_batches_touch_few_buckets(spark, folder):
    store = EntityStore(spark, folder, 64)
    make = lambda names: spark.createDataFrame([(n, "d", ["c"]) for n in names], "name string, description string, chunk_ids array<string>")
    none = spark.createDataFrame([], "a string, b string")
    store.merge(make([f"n{i}" for i in range(500)]), none, 0)
    assert max(store.merge(make(["n7", "fresh"]), none, 1).values()) <= 2
    assert {r.records for r in store.entities.lookup(spark.createDataFrame([("n7",)], "label string")).collect()} == {2}


# --- graphs that follow their documents


def test_graph_after_changes_equals_a_rebuild(spark, folder):
    rng = random.Random(12)
    docs = {}
    for d in range(24):
        name = lambda: f"e{rng.randrange(14)}"
        chunks = [f"d{d}-{k}" for k in range(rng.randrange(4))]
        nodes = [(rng.choice([name(), name(), " "]), rng.choice("xyz"), rng.choice(["p", "q"]), c, 100 * d + k) for c in chunks for k in range(rng.randrange(3))]
        edges = [(name(), rng.choice([name(), None, f"only{d}"]), rng.choice(["k,l", "m"]), float(rng.randrange(4)), rng.choice(["r", "s"]), c) for c in chunks for _ in range(rng.randrange(3))]
        docs[f"d{d}"] = (chunks, nodes, edges)

    def frames(names):
        return (
            spark.createDataFrame([(d, c) for d in names for c in docs[d][0]], "doc_id string, chunk_id string"),
            spark.createDataFrame([n for d in names for n in docs[d][1]], "name string, type string, description string, source_id string, pos long"),
            spark.createDataFrame([e for d in names for e in docs[d][2]], "node1 string, node2 string, keywords string, weight double, description string, source_id string"),
        )

    def state(s):
        return [sorted(map(tuple, t.read().select(*t.columns).collect()), key=str) for t in (s.entities, s.relations, s.met, s.nodes, s.ends)]

    store, every = GraphStore(spark, folder + "/a", 4), list(docs)
    store.ingest("a", *frames(every[:16]))
    gone = [*every[3:9], "not there"]
    chunks, nodes, edges = frames(every[16:])
    store.change("b", chunks, nodes, edges, spark.createDataFrame([(d,) for d in gone], "doc_id string"))
    left = GraphStore(spark, folder + "/b", 4)
    left.ingest("a", *frames([d for d in every if d not in gone]))
    assert state(store) == state(left)
    assert any(r.type == "UNKNOWN" for r in left.entities.read().collect())
    assert set(store.delete_documents("b", spark.createDataFrame([("d0",)], "doc_id string")).values()) == {0}  # that tag was taken
    store.delete_documents("c", spark.createDataFrame([(d,) for d in every], "doc_id string"))
    assert state(store) == [[]] * 5


def test_graph_keeps_one_copy_of_what_it_holds(spark, folder, monkeypatch):
    """Logs of finished changes and tables in between stayed beside every version."""
    from lakeloom.operators import graph_store

    made = []
    monkeypatch.setattr(graph_store, "materialize", lambda df, name, real=graph_store.materialize: made.append(real(df, name)) or made[-1])
    store = GraphStore(spark, folder, 4, keep=1)
    chunks = spark.createDataFrame([(f"d{i}", f"c{i}") for i in range(12)], "doc_id string, chunk_id string")
    nodes = spark.createDataFrame([(f"n{i % 5}", "t", f"text {i}", f"c{i}", i) for i in range(12)], "name string, type string, description string, source_id string, pos long")
    edges = spark.createDataFrame([(f"n{i % 5}", f"n{i % 3 + 5}", "k", 1.0, "e", f"c{i}") for i in range(12)], "node1 string, node2 string, keywords string, weight double, description string, source_id string")
    assert all(store.ingest("a", chunks, nodes, edges).values())
    store.delete_documents("b", spark.createDataFrame([("d0",), ("d7",)], "doc_id string"))
    assert {r.name for r in store.nodes.read().collect()} == {f"n{i}" for i in range(5)} and store.nodes.read().count() == 10
    assert len(made) == 10 and not any(children(spark, df.materialized_at) for df in made)
    for name in ("met", "nodes", "ends", "entities", "relations"):
        assert len(getattr(store, name).versions()) == 1
    assert [children(spark, f"{folder}/log/{tag}") for tag in "ab"] == [["done"], ["done"]]


def test_a_change_comes_in_waves_and_copies_no_table(spark, folder, monkeypatch):
    """A change wrote all new rows of five tables beside the tables and shuffled each table at once."""
    from lakeloom.operators import graph_store

    chunks = spark.createDataFrame([(f"d{i}", f"c{i}") for i in range(9)], "doc_id string, chunk_id string")
    nodes = spark.createDataFrame([(f"n{i % 5}", "t", f"text {i}", f"c{i}", i) for i in range(8)], "name string, type string, description string, source_id string, pos long")
    edges = spark.createDataFrame([(f"n{i % 5}", f"n{i % 3 + 5}", "k", 1.0, "e", f"c{i}") for i in range(8)], "node1 string, node2 string, keywords string, weight double, description string, source_id string")
    gone = spark.createDataFrame([("d0",), ("d7",)], "doc_id string")
    whole = GraphStore(spark, folder + "/whole", 3, keep=1)
    whole.ingest("a", chunks, nodes, edges)
    whole.delete_documents("b", gone)

    monkeypatch.setattr(graph_store, "WAVE_BYTES", 1, raising=False)
    waves, faults, real = [], [], KeyedTable.put

    def put(table, keys, rows, tag=None, n=1, by=None):
        if table.path.endswith("entities") and not faults:
            faults.append(children(spark, f"{folder}/parts/log/a"))
            raise OSError("no space left")
        waves.append(n)
        return real(table, keys, rows, tag, n, by)

    monkeypatch.setattr(KeyedTable, "put", put)
    parts = GraphStore(spark, folder + "/parts", 3, keep=1)
    with pytest.raises(OSError):
        parts.ingest("a", chunks, nodes, edges)
    assert faults == [["delta"]] and len(parts.nodes.versions()) == 1 and not parts.entities.versions()
    parts.ingest("a", chunks, nodes, edges)
    parts.delete_documents("b", gone)
    assert set(waves) == {3} and children(spark, f"{folder}/parts/log/a") == ["done"]
    for name in ("met", "nodes", "ends", "entities", "relations"):
        one, other = (sorted(map(str, getattr(s, name).read().collect())) for s in (whole, parts))
        assert one == other and one
