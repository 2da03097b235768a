"""The document queue, wikis under edits, multi-hop evidence and model slots."""

import random
import time
import uuid

import pytest

from lakeloom.operators.evidence import best_paths, citations
from lakeloom.operators.model_slots import Slot, batches, rerank_pairs, score_pairs
from lakeloom.operators.wiki import EDITS, Wiki, lint, scheduled
from lakeloom.sources.keyed import KeyedTable
from lakeloom.streaming.queue import DocumentQueue


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


# --- queue


def test_queue_survives_a_death_in_every_step(spark, folder):
    """A run that dies leaves documents in work; another takes them when stale; every result counts once."""
    q = DocumentQueue(spark, folder, 4)
    docs = spark.createDataFrame([("a", "one"), ("b", "two"), ("b", "two b"), ("c", None), (None, "x")], "doc_id string, text string")
    q.enqueue(docs, "t0")
    q.enqueue(docs, "t1")  # known already
    seen = []

    def process(rows):
        got = [r.asDict() for r in rows.collect()]
        seen.extend((r["doc_id"], r["attempts"]) for r in got)
        return spark.createDataFrame([(r["doc_id"], r["doc_id"] != "c", "bad", f"{r['text']}!") for r in got if r["doc_id"] != "d"], "doc_id string, ok boolean, error string, output string")

    def dies(rows):
        raise OSError("dies")

    state = lambda: {r.doc_id: (r.status, r.attempts, r.error) for r in q.status.read().collect()}
    with pytest.raises(OSError):
        q.drain(dies, now=100)
    assert state() == {k: ("PROCESSING", 1, None) for k in "abc"}
    assert DocumentQueue(spark, folder, 4).drain(process, now=150, stale=60) == 0  # still in someone's hands
    replace, calls = KeyedTable.replace, []

    def twice(self, changes, tag=None):
        calls.append(tag)
        if len(calls) == 2:  # results are written, the status is not
            raise OSError("dies")
        return replace(self, changes, tag)

    KeyedTable.replace = twice
    try:
        with pytest.raises(OSError):
            q.drain(process, now=200, stale=60)
    finally:
        KeyedTable.replace = replace
    assert sorted(seen) == [("a", 2), ("b", 2), ("c", 2)] and state()["a"][0] == "PROCESSING"
    more = [spark.createDataFrame([("d", "late")], "doc_id string, text string")]
    assert q.drain(process, now=210, stale=60, arrivals=lambda: more and q.enqueue(more.pop(), "t2", 210)) == 3
    assert state() == {"a": ("PROCESSED", 2, None), "b": ("PROCESSED", 2, None), "c": ("FAILED", 3, "bad"), "d": ("FAILED", 3, "failed")}
    assert sorted(map(tuple, q.outputs().collect())) == [("a", "one!"), ("b", "two!")]
    assert seen.count(("a", 2)) == 1 and q.drain(process, now=10**6) == 0


# --- wiki


def edits_by_hand(pages, edits):
    pages, said = dict(pages), []
    for seq, op, path, old, new in sorted(edits, key=lambda e: e[0]):
        if op == "create" and new and new.startswith("---\ntitle: "):
            path = "pages/" + new.split("\n")[1][7:].replace(" ", "-") + ".md"
        if path.startswith("/") or ".." in path:
            r = "error: invalid path"
        elif op == "create":
            r = "error: already exists" if path in pages else "ok: created"
            pages.setdefault(path, new or "")
        elif path not in pages:
            r = "error: does not exist"
        elif op == "delete":
            r = "ok: deleted"
            del pages[path]
        elif op != "edit":
            r = "error: unknown operation"
        else:
            n = pages[path].count(old) if old else 0
            r = "error: not found" if n == 0 else f"error: matches {n}" if n > 1 else "ok: edited"
            if n == 1:
                pages[path] = pages[path].replace(old, new or "")
        said.append((seq, path, r))
    return pages, sorted(said)


def test_edits_in_order_against_plain_python(spark, folder):
    rng = random.Random(5)
    pages = {f"pages/p{i}.md": " ".join(rng.choice(["a.b", "$1", "x\\", "é世", "aa"]) for _ in range(6)) for i in range(12)}
    edits = []
    for seq in range(150):
        path = rng.choice([f"pages/p{rng.randrange(15)}.md"] * 9 + ["/abs.md", "pages/../up.md"])
        op = rng.choice(["edit"] * 6 + ["create", "delete", "rename"])
        old, new = rng.choice(["a.b", "$1", "x\\", "世", "a", "", None, "aa"]), rng.choice(["$2", "new", "", "a.b", None])
        edits.append((seq, op, path, old, f"---\ntitle: T {seq % 7}\n---\n" if op == "create" and seq % 2 else new))
    wiki = Wiki(spark, folder, 4)
    wiki.table.replace(spark.createDataFrame([(*p, False) for p in pages.items()], "path string, content string, gone boolean"))
    copy = wiki.work(spark.createDataFrame(edits, EDITS).repartition(3))
    want, said = edits_by_hand(pages, edits)
    assert sorted(map(tuple, copy.results().collect())) == said
    assert dict(map(tuple, wiki.preview(copy).collect())) == want and dict(map(tuple, wiki.pages().collect())) == pages


def test_promotion_refusal_and_rollback(spark, folder):
    wiki = Wiki(spark, folder, 4)
    work = lambda *e: wiki.work(spark.createDataFrame(list(e), EDITS))
    pages = lambda: dict(map(tuple, wiki.pages().collect()))
    assert wiki.promote(work((1, "create", "index.md", None, "[[One]] [[Two|second]]"), (2, "create", "pages/One.md", None, "see [[Two#part]]"), (3, "create", "pages/Two.md", None, "one two")))
    first = pages()
    found = lambda p: sorted((r.kind, r.path, r.target) for r in lint(p).collect())
    assert found(wiki.pages()) == [("orphan", "pages/One.md", None)]
    bad = work((1, "delete", "pages/Two.md", None, None), (2, "edit", "pages/One.md", "see", ""))
    assert not wiki.promote(bad, check=lambda p: lint(p).where("kind = 'dead link'")) and pages() == first and wiki.version() == 1
    assert found(wiki.preview(bad)) == [("dead link", "index.md", "Two|second"), ("dead link", "pages/One.md", "Two#part"), ("orphan", "pages/One.md", None)]
    assert not wiki.promote(work((1, "edit", "pages/Two.md", "one two", " \n")))  # an empty page
    assert found(wiki.preview(work((1, "edit", "pages/Two.md", "one two", " \n"))))[0] == ("empty", "pages/Two.md", None)

    mine, other = work((1, "edit", "pages/Two.md", "one", "1")), work((1, "edit", "pages/Two.md", "two", "2"), (2, "create", "pages/Three.md", None, "3"))
    clash = work((1, "edit", "pages/Two.md", "one two", "12"))
    assert wiki.promote(other) and wiki.promote(mine) and pages()["pages/Two.md"] == "1 2"  # edits of both
    assert not wiki.promote(clash) and pages()["pages/Two.md"] == "1 2"
    wiki.rollback(1)
    assert pages() == first


def test_scheduled_lint(spark, folder):
    """Ticks follow each other; a schedule that is started again goes on where it stopped."""
    wiki, ticks = Wiki(spark, folder + "/w", 2), []
    wiki.table.replace(spark.createDataFrame([("pages/A.md", "[[B]]", False)], "path string, content string, gone boolean"))

    def run(until):
        query = scheduled(spark, lambda tick: ticks.append((tick, lint(wiki.pages()).where("kind = 'dead link'").count())), folder + "/c", "100 milliseconds")
        end = time.time() + 60
        while len(ticks) < until and time.time() < end:
            time.sleep(0.1)
        query.stop()
        return len(ticks)

    n = run(2)
    run(n + 2)
    assert n >= 2 and len(ticks) >= n + 2 and ticks[n][0] in (ticks[n - 1][0], ticks[n - 1][0] + 1)
    assert {t for t, _ in ticks} == set(range(ticks[-1][0] + 1)) and {k for _, k in ticks} == {1}


# --- evidence


def test_paths_with_types_beam_and_stop(spark):
    start = spark.createDataFrame([(1, "a", 1, 0.5), (1, "a", 1, 0.7), (2, "a", 9, 0.1), (3, "a", None, 1.0)], "qid long, type string, id long, score double")
    edges = [("e1", "a", 1, "b", 1, 0.1), ("e2", "a", 1, "b", 1, 0.2), ("e3", "a", 1, "b", 2, 0.2), ("e0", "a", 1, "b", 2, 0.2), ("e4", "b", 1, "a", 2, 0.0), ("e5", "b", 2, "a", 2, 0.0), ("e6", "b", 2, "a", 1, 9.0), ("e7", "a", 2, "c", 1, 1.0), ("e8", "a", 9, "c", 5, 1.0), ("e9", "c", 5, "c", 6, 1.0)]
    edges = spark.createDataFrame(edges, "edge string, src_type string, src long, dst_type string, dst long, gain double")
    rows = lambda df: sorted((r.qid, r.type, r.id, r.hop, r.score, r.path) for r in df.collect())
    got = rows(best_paths(start, edges, 5))
    assert got == [
        (1, "a", 1, 0, 0.7, []), (1, "a", 2, 2, 0.9, ["e0", "e5"]), (1, "b", 1, 1, 0.9, ["e2"]), (1, "b", 2, 1, 0.9, ["e0"]), (1, "c", 1, 3, 1.9, ["e0", "e5", "e7"]),
        (2, "a", 9, 0, 0.1, []), (2, "c", 5, 1, 1.1, ["e8"]), (2, "c", 6, 2, 2.1, ["e8", "e9"]),
    ]
    stopped = rows(best_paths(start, edges, 5, enough=lambda f: f.where("type = 'c'")))
    assert stopped == [r for r in got if r[2] != 6]
    assert [r for r in rows(best_paths(start, edges, 1, beam=1)) if r[3] == 1] == [(1, "b", 1, 1, 0.9, ["e2"]), (2, "c", 5, 1, 1.1, ["e8"])]
    cited = citations(best_paths(start, edges, 5), spark.createDataFrame([("e0", "s"), ("e5", "s"), ("e7", "t"), ("e9", "s")], "edge string, source string"))
    assert sorted(map(tuple, cited.collect())) == [(1, "s", 2), (1, "t", 1), (2, "s", 1)]
    assert best_paths(start.limit(0), edges).count() == 0


# --- model slots


def test_slots_load_once_batch_and_fall_back(spark):
    loads, calls, pairs_seen, failures = (spark.sparkContext.accumulator(0) for _ in range(4))

    def load():
        loads.add(1)

        def score(pairs):
            calls.add(1)
            pairs_seen.add(len(pairs))
            assert sum(len(q.split()) + len(t.split()) for q, t in pairs) <= 40 or len(pairs) == 1
            return [float(len(t)) for _, t in pairs]

        return score

    def flaky():
        state = {"n": 0}

        def score(pairs):
            state["n"] += 1
            if state["n"] % 3:
                failures.add(1)
                raise TimeoutError("busy")
            return [1.0] * len(pairs)

        return score

    def dead():
        raise ImportError("no weights")

    rows = [(i % 5, ["good", "flaky", "dead", "short", None][i % 5], i, i // 5, "q q", "t " * (i % 30) if i != 40 else None, "extra") for i in range(400)]
    df = spark.createDataFrame(rows, "qid long, mode string, id long, rank long, query string, text string, model string").repartition(2)
    short = Slot(lambda: lambda pairs: [1.0] * (len(pairs) - 1))
    slots = {"good": Slot(load, max_tokens=40, max_rows=6), "flaky": Slot(flaky, max_rows=10), "dead": Slot(dead), "short": short}
    out = score_pairs(df, slots).cache()
    got = {r.id: r for r in out.collect()}
    assert len(got) == 400 and loads.value == 2 and pairs_seen.value == 80 and calls.value >= 14
    assert all(got[i].model_score == len(got[i].text or "") and got[i].model_fault is None for i in range(0, 400, 5))
    assert all(got[i].model_score == 1.0 for i in range(1, 400, 5)) and failures.value >= 16
    assert all(got[i].model_score is None and got[i].model_fault == "ImportError: no weights" for i in range(2, 400, 5))
    assert all(got[i].model_score is None and got[i].model_fault == "ValueError: scores missing" for i in range(3, 400, 5))
    assert all(got[i].model_score is None and got[i].model_fault is None for i in range(4, 400, 5))
    ranked = {}
    for r in rerank_pairs(df, slots, 4).orderBy("qid", "pos").collect():
        ranked.setdefault(r.qid, []).append(r.id)
        assert r.fell_back == (r.qid in (2, 3, 4))
    best = sorted(range(0, 400, 5), key=lambda i: (-len(got[i].text or ""), i))[:4]
    assert ranked == {0: best, 1: [1, 6, 11, 16], 2: [2, 7, 12, 17], 3: [3, 8, 13, 18], 4: [4, 9, 14, 19]}
    high = rerank_pairs(df, slots, 100, least=57.0).where("qid < 2").groupBy("qid", "fell_back").count().collect()
    assert {(r.qid, r.fell_back, r["count"]) for r in high} == {(0, False, sum(len(got[i].text or "") >= 57 for i in range(0, 400, 5))), (1, True, 80)} or not any(len(got[i].text or "") >= 57 for i in range(0, 400, 5))
    assert batches([5, 5, 50, 1, 1, 1], 10, 2) == [(0, 2), (2, 3), (3, 5), (5, 6)] and batches([], 1, 1) == []


def test_no_rows_for_slots(spark):
    df = spark.createDataFrame([], "qid long, mode string, id long, rank long, query string, text string")
    assert rerank_pairs(df, {}, 3).count() == 0 and score_pairs(df, {"a": Slot(lambda: None)}).columns[-2:] == ["model_score", "model_fault"]
