"""A batch of searches, block against block, equals the sum over joined rows."""

import numpy as np
import pytest

from lakeloom.operators import text_index
from lakeloom.operators.text_index import TextIndex


@pytest.mark.parametrize("all_terms", [False, True])
def test_searches_by_blocks(spark, tmp_path, monkeypatch, all_terms):
    monkeypatch.setattr(text_index, "QUERY_BLOCK", 7)
    monkeypatch.setattr(text_index, "DOC_BLOCK", 20)
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(1, 30)) % 40)) for i in range(150)]
    index = TextIndex(spark, str(tmp_path), 4)
    index.insert(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = [(q, f"w{int(t)}") for q in range(20) for t in rng.integers(0, 45, 3)]
    text = {i: t.split() for i, t in docs}
    avg, df = np.mean([len(t) for t in text.values()]), {}
    for t in text.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    want = {}
    for q in range(20):
        words, rows = {t for a, t in asked if a == q}, []
        known = words & set(df)
        for i, t in text.items():
            hit = sorted(known & set(t))
            if hit and (not all_terms or len(hit) == len(words)):
                s = sum(np.log(1 + (150 - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in hit)
                rows.append((-round(float(s), 6), i, len(hit)))
        want |= {(q, i): (-s, m, n) for n, (s, i, m) in enumerate(sorted(rows)[:6], 1)}
    queries = spark.createDataFrame(asked, "qid long, term string")
    got = {(r.qid, r.id): (r.score, r.matched, r.rank) for r in index.search(queries, 6, all_terms).collect()}
    assert got.keys() == want.keys() and all(got[x][1:] == want[x][1:] and got[x][0] == pytest.approx(want[x][0], abs=2e-6) for x in want)
    sent = index.search(queries, 6, all_terms)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in sent  # no row for each query and document of a term
    assert index.search(queries, None).count() > len(want)
