"""Learned words, parsed documents and clusters by parts."""

import json
import math
import random
from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from lakeloom.operators.dedup import agglomerate, agglomerate_parts
from lakeloom.operators.retrieval import bm25
from lakeloom.operators.segmenter import best_path, learn_words, segmenter
from lakeloom.sources import unified as U

WORDS = ["世界", "你好", "学习", "机器学习", "很", "大", "模型", "语言"]


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    return [(i, "，".join("".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 9))) for _ in range(2)) + " GPT-4 ok") for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "no han")]


def test_learned_words_by_hand(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: (r.n, r.logp) for r in learn_words(df, F.col("text"), min_entropy=0.8).collect()}
    runs = [r for _, t in rows if t for part in t.split("，") for r in [part.split(" ")[0]] if r and ord(r[0]) > 0x4E00]
    n, left, right = Counter(), {}, {}
    for r in runs:
        for i in range(len(r)):
            for k in range(1, min(4, len(r) - i) + 1):
                g = r[i : i + k]
                n[g] += 1
                left.setdefault(g, Counter())[r[i - 1] if i else ""] += 1
                right.setdefault(g, Counter())[r[i + k : i + k + 1]] += 1
    total = sum(c for g, c in n.items() if len(g) == 1)
    entropy = lambda c: -sum(x / c.total() * math.log(x / c.total()) for x in c.values())
    want = {g for g in n if len(g) == 1} | {
        g for g in n if len(g) > 1 and n[g] >= 5 and min(entropy(left[g]), entropy(right[g])) >= 0.8 and min(math.log(n[g] * total / n[g[:k]] / n[g[k:]]) for k in range(1, len(g))) >= 1
    }
    assert set(got) == want and all(got[g][0] == n[g] and abs(got[g][1] - math.log(n[g] / total)) < 1e-9 for g in got)
    assert {"世界", "你好", "机器学习", "模型", "语言"} <= set(got) and "界你" not in got
    assert learn_words(df.limit(0), F.col("text")).count() == 0


def test_best_path_against_every_cut():
    rng = random.Random(4)
    for _ in range(200):
        run = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9)))
        logp = {w: -rng.random() * 6 for w in {run[i:j] for i in range(len(run)) for j in range(i + 1, min(len(run), i + 3) + 1)} if rng.random() < 0.6}
        path = best_path(run, logp, 3, -9.0)
        cost = lambda ws: sum(logp.get(w, -9.0 if len(w) == 1 else -math.inf) for w in ws)
        cuts = product([0, 1], repeat=max(0, len(run) - 1))
        every = []
        for c in cuts:
            at = [0, *[i + 1 for i, x in enumerate(c) if x], len(run)]
            every.append([run[a:b] for a, b in zip(at, at[1:])] if run else [])
        assert "".join(path) == run and abs(cost(path) - max(cost(ws) for ws in every if all(len(w) <= 3 for w in ws))) < 1e-9


def test_search_with_learned_words(spark):
    """A word is found as one; characters are brought to one script first; other runs split at white space."""
    df = spark.createDataFrame([*corpus(), (900, "機器學習 模型GPT-4")], "doc_id long, text string")
    script = {"機": "机", "學": "学", "習": "习"}
    cut = segmenter(learn_words(df, F.col("text"), simplified=script), simplified=script)
    got = {r.doc_id: r.t for r in df.select("doc_id", cut(F.col("text")).alias("t")).collect()}
    assert got[900] == ["机器学习", "模型", "GPT-4"] and got[300] == [] and got[302] == ["no", "han"] and got[0][-2:] == ["GPT-4", "ok"]
    assert all("".join(t) == (x or "").translate(str.maketrans(script)).replace(" ", "") for i, x in corpus() for t in [got[i]])
    hits = {r.doc_id for r in bm25(df, ["机器学习"], tokens=cut).collect()}
    assert hits == {i for i, t in got.items() if "机器学习" in t} and 900 in hits


def test_parsed_documents(spark, tmp_path):
    """Documents with gaps, faults and repeated images; an image between pages sees both neighbours."""
    el = lambda *a: {"type": a[0], "text": a[1] if len(a) > 1 else None, "key": a[2] if len(a) > 2 else None}
    docs = [
        {"doc_id": "a", "source": "s", "description": "About a", "extra": {"x": [1]}, "pages": [
            {"page": 3, "elements": [el("text", "three"), el("table", "| t |")]}, {"page": 1, "elements": [el("text", "one"), el("image", None, "k1")]},
            {"page": 2, "elements": [el("image", "alt", "k2"), el("text", " "), el("image", None, "")]}, {"page": 9, "elements": [el("image", None, "k3")]}]},
        {"doc_id": "b", "pages": [{"elements": [el("image", None, "k1")]}, {"elements": [el("text", "second")]}, {}]},
        {"doc_id": "c"},
    ]
    path = tmp_path / "docs.jsonl"
    path.write_text("\n".join([json.dumps(d) for d in docs] + ["", "{broken", "[1, 2]"]))
    d = U.read_unified(spark, str(path))
    assert sorted((r.doc_id or "", r.source, r.description, r.fault) for r in d.select("doc_id", "source", "description", "fault").collect()) == [
        ("", None, None, "[1, 2]"), ("", None, None, "{broken"), ("a", "s", "About a", None), ("b", None, None, None), ("c", None, None, None),
    ]
    e = U.page_elements(d)
    assert [(r.page, r.pos, r.type) for r in e.where("doc_id = 'b'").orderBy("page", "pos").collect()] == [(1, 0, "image"), (2, 0, "text")]
    assert {(r.doc_id, r.page): r.text for r in U.page_texts(e).collect()} == {("a", 1): "one", ("a", 3): "three\n| t |", ("b", 2): "second"}
    c = U.image_context(d, e)
    assert {r.key: (r.doc_id, r.page, r.context) for r in c.collect()} == {"k1": ("a", 1, "About a\none"), "k2": ("a", 2, "About a\none\nthree\n| t |"), "k3": ("a", 9, "About a\n")}
    out = U.image_documents(c, F.when(F.col("key") != "k3", F.concat(F.lit("Picture "), "key")), F.lit(None).cast("string"))
    made = tmp_path / "made"
    out.select("value").write.text(str(made))
    again = U.read_unified(spark, str(made))
    assert sorted((r.page, r.type, r.text, r.key) for r in U.page_elements(again).collect()) == [(1, "text", "Picture k1", "k1"), (1, "text", "Picture k2", "k2")]
    assert {r.parent for r in again.select(F.expr("variant_get(doc, '$.parent', 'string')").alias("parent")).collect()} == {"a"}


def test_clusters_by_parts_equal_those_of_whole_batches(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        base = [1.0 if k == i % 9 else 0.0 for k in range(9)]
        rows.append((i % 2 + 1, i, [b + rng.gauss(0, rng.choice([0.01, 0.02, 0.05])) for b in base]))
    rows += [(1, 1000 + k, rows[0][2]) for k in range(5)]
    df = spark.createDataFrame(rows, "label int, vec_id long, embedding array<double>")
    whole = sorted(map(tuple, agglomerate(df, "label").collect()))
    assert sorted(map(tuple, agglomerate_parts(df, "label").collect())) == whole and len({c for _, _, c in whole}) < 200
    assert agglomerate_parts(df.limit(0), "label").count() == 0


def test_agglomerative_query_holds_parts_only(spark, monkeypatch):
    """The query gave each label whole to one task."""
    from lakeloom import catalog
    from lakeloom.operators import dedup

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("label IS NOT NULL")
    want = sorted(map(tuple, agglomerate(e, "label").collect()))
    keys = []
    monkeypatch.setattr(dedup, "agglomerate", lambda df, batch, *a: keys.append(batch) or agglomerate(df, batch, *a))
    assert sorted(map(tuple, catalog.QUERIES["a27_agglomerative"](spark, "/root/testdata/sf0.001").collect())) == want and keys == ["part"]
