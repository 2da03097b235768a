"""A large component meets what is near it as one holder and not set by set."""

import random

import pytest

from lakeloom.llm import ngram_join

from test_llm import components, table


def test_crowd_is_one_holder(spark):
    """Thirty joined sets and ten others share signatures: a row for each of the others, none for each pair of sets."""
    members, others = list(range(30)), list(range(100, 110))
    rows = [(s, True, k, 10 + k % 3, 9, 1, 9, *[None] * 8) for k in members for s in range(20)]
    rows += [(s, True, k, 10, 8, 1, 9, *[None] * 8) for k in others for s in range(8)]
    postings = spark.createDataFrame(rows, "sig long, single boolean, key long, n int, rare int, rest int, end long, " + ", ".join(f"m{i} long" for i in range(8)))
    parts = spark.createDataFrame([(k, 0) for k in members] + [(k, 100) for k in others[:5]], "key long, component long")
    got = [(r.a, r.b) for r in ngram_join._across(postings, parts).where("a < 30 OR b < 30").collect()]
    assert sorted(got) == [(0, k) for k in others]


@pytest.mark.parametrize("crowd, frequent", [(1, 64), (3, 2), (8, 8)])
def test_crowds_against_brute_force(spark, monkeypatch, crowd, frequent):
    """A chain of near copies whose ends do not link, texts that link with one set of it only, and texts that link with none."""
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "VERIFY_ROWS", 4)
    rng = random.Random(crowd)
    text, rows = [f"w{i}" for i in range(120)], []
    for i in range(40):
        text = [*text[2:], f"x{i}", f"y{i}"]
        rows.append((i, " ".join(text)))
    for i in range(40, 80):
        words = rows[rng.randrange(40)][1].split()
        at = rng.randrange(100)
        rows.append((i, " ".join([*words[:at], *[f"n{i}u{j}" for j in range(rng.choice([8, 14, 18, 25]))], *words[at + rng.choice([0, 5]) :]])))
    rng.shuffle(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(table(spark, rows)).collect()} == components(rows)
