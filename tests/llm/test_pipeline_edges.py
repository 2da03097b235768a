"""Every stage of the pipeline on nulls, empty texts, ties, repeated rows, clashing columns and an empty table."""

import hashlib

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, taken int, `key` string, kept string, spans string, component_id string"
PLAIN = "a clean text about rivers, bridges and weather in spring that nobody would mind at all"
KEY = "password = Xk29fQm4Lz81TrBv7Wn3"
ROWS = [
    (1, PLAIN, "en", "s", 85), (1, PLAIN, "en", "s", 85), (2, None, None, None, None), (3, "", "en", None, 0), (None, "no id but some words here to keep", "en", "s", 33),
    (4, " \t\n", "en", "t", 3), (5, PLAIN, "en", "t", 85), (6, f"note: {KEY} end of it", "en", "t", 40), (7, "x" * 5000, "en", None, 5000), (2, None, None, None, None),
]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "row", 7, 8, "k", "kept", "sp", "c") for r in rows], SCHEMA).repartition(3)


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.source, r.n_chars) for r in df.collect()), key=str)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_of_nothing(spark, name, stage):
    assert stage(spark, docs(spark, []), FOLDER).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_edges(spark, name, stage):
    given = docs(spark, ROWS)
    out = stage(spark, given, FOLDER)
    if name == "bpe":  # a null text is an empty one; every row has its own
        got = [(r.doc_id, r.n_tokens, r.decoded_sha256) for r in out.collect()]
        assert sorted(((i, h) for i, _, h in got), key=str) == sorted(((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in ROWS), key=str)
        assert all((n == 0) == (h == hashlib.sha256(b"").hexdigest()) for _, n, h in got)
        return
    assert out.columns == given.columns
    got, want = rows_of(out), sorted([(r[0], r[1], r[3], r[4]) for r in ROWS], key=str)
    if name == "toxicity":  # clean, empty and null texts stay as they were
        assert got == want
    elif name == "ngram_join":  # one document of each group: 5 goes, both rows of 1 stay, and all without shingles
        assert got == [w for w in want if w[0] != 5]
    elif name == "secrets":
        assert [g for g in got if g[0] != 6] == [w for w in want if w[0] != 6]
        (masked,) = [g for g in got if g[0] == 6]
        assert "Xk29fQm4Lz81TrBv7Wn3" not in masked[1] and masked[1].startswith("note: ") and masked[1].endswith(" end of it") and masked[3] == len(masked[1])
    else:  # documents without words stay once, others as often as the mix takes them
        assert {g[0] for g in got} >= {2, 3, 4} and all(any(g[1] is None and w[1] is None or g[1] is not None and w[1] is not None and w[1].startswith(g[1]) for w in want if w[0] == g[0]) for g in got)
        assert sum(g[0] == 3 for g in got) == 1 and all(r.row == "row" and r.size == 7 for r in out.collect())
