"""Line dedup, whitening and the Merkle manifest against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import line_dedup, merkle, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, pos int, key string, tree string, node string"


def documents(spark, rows, schema=DOCS):
    """rows of (doc_id, text, source), with columns whose names the operators use themselves."""
    full = [(i, t, None if n % 3 == 0 else "en", s, len(t or "") or None, "h", 1, "k", "t", "n") for n, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(full, schema).repartition(3)


def long_line(k):
    return f"Shared line number {k} that has more than forty letters, é世"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(0, None, "a"), (1, "", "a"), (2, "\n\n", None), (3, " \t", ""), (2**60 + 1, "one\n" + long_line(0), "a"), (None, long_line(0) + "\n" + long_line(1), None), (None, "x", "b")]
    for i in range(10, 70):
        lines = []
        for _ in range(rng.randrange(12)):
            k = rng.randrange(14)
            line = long_line(k) if k > 3 else f"own {i} {rng.random()} and something to make it rather long" if k else "short"
            lines.append(rng.choice(["", " ", "\t\x0b"]) + (line.upper().replace("É", "é") if rng.random() < 0.3 else line) + rng.choice(["", "\r", " \x0c"]))
        out.append((i, "\n".join(lines), rng.choice(["a", "a", "b", None, "é", "z", "\U0001f600", "￮"])))
    out.append((11, out[8][1], "a"))  # a repeated row of one id, of another text than the first
    out.append((70, "\n".join([long_line(9)] * 3000 + ["end"]), "c"))
    return out


# --- op11


def dedup_lines(rows, least=40, docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    holders = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        stays = [len(holders.get(key(x), ())) < docs or (i is not None, i) == max(((h is not None, h) for h in holders[key(x)]), key=lambda h: (h[0], h[1] if h[0] else 0)) for x in lines]
        out.append((i, len(lines), len(lines) - sum(stays), "\n".join(x for x, s in zip(lines, stays, strict=True) if s)))
    return sorted(out, key=str)


def test_line_dedup(spark, rows):
    for least, docs in ((40, 5), (1, 2), (40, 1)):
        got = line_dedup.line_dedup(documents(spark, rows), least, docs).collect()
        assert sorted([tuple(r) for r in got], key=str) == dedup_lines(rows, least, docs)
    assert sum(r[2] for r in dedup_lines(rows)) > 100
    assert line_dedup.line_dedup(documents(spark, [])).count() == 0


def test_line_dedup_threshold_and_keeper(spark):
    """Four documents are too few, five are enough; the document of the largest id keeps all its copies; 39 letters are too short."""
    a, b, c = "a" * 40, "b" * 40, "c" * 39
    docs = [(i, f"{a}\n{b if i < 5 else 'x'}\n{c}", "s") for i in range(1, 5)] + [(9, f"{a}\n{a}\n{c}", "s")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.line_dedup(documents(spark, docs)).collect()}
    assert got == {9: (3, 0, f"{a}\n{a}\n{c}")} | {i: (3, 1, f"{b}\n{c}") for i in range(1, 5)}


def test_line_dedup_with_string_ids(spark, rows):
    named = [(None if i is None else f"d{i}", t, s) for i, t, s in rows]
    got = line_dedup.line_dedup(documents(spark, named, DOCS.replace("doc_id long", "doc_id string"))).collect()
    assert sorted([tuple(r) for r in got], key=str) == dedup_lines(named)


# --- op12


def whiten_by_hand(rows):
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    n, mean = len(fit), fit.mean(0)
    cov = (fit - mean).T @ (fit - mean) / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    sums = [sum(c) for c in zip(*{tuple(x) for _, x in good}, strict=True)]
    return good, n, sums, mean, e, q, np.trace(cov)


def test_whitening(spark):
    rng = np.random.default_rng(4)
    d = 12
    base = rng.normal(size=(700, d)) @ np.diag(np.linspace(0.02, 0.9, d)) + 0.3
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    vectors += [(1000 + i, vectors[5][1]) for i in range(300)] + [(None, vectors[6][1]), (5, vectors[5][1])]  # copies count once
    vectors += [(2000, None), (2001, []), (2002, [1.0] * (d - 1) + [None]), (2003, [float("nan")] * d), (2004, [float("inf")] + [0.0] * (d - 1)), (2005, [0.5] * (d - 1))]
    df = spark.createDataFrame([(i, v, 1, 2, "z") for i, v in vectors], "vec_id long, embedding array<float>, label int, component int, x string").repartition(5)
    got = whitening.whiten(df).collect()
    good, n, sums, mean, e, q, trace = whiten_by_hand([r for r in vectors if r[1] is None or len(r[1]) != d - 1])
    assert len(got) == 4 * len(good)
    by = defaultdict(list)
    for r in got:
        assert r.n == n and abs(r.explained - e[r.component - 1] / trace) < 1e-9 and r.identity_error < 1e-9
        by[r.vec_id, r.component].append(r)
    sign = {}
    for i, x in good:
        away = [n * c - s for c, s in zip(x, sums, strict=True)]
        for k in range(1, 5):
            want = (np.array(x) - mean) @ q[:, k - 1] / math.sqrt(e[k - 1])
            r = by[i, k][0]
            sign.setdefault(k, np.sign(want * r.whitened))
            assert r.deviation == sum(c * c for c in away) and abs(r.whitened * sign[k] - want) < 1e-8


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(6)
    for n, low, high in ((1, -3, 4), (63, -300, 300), (64, 5, 6), (1000, -(2**40), 2**41), (130, -(2**62), 2**62), (7, -(2**63), 2**63 - 1)):
        x = rng.integers(low, high, (n, 5), dtype=np.int64)
        sums, products = whitening.scatter(x)
        own = [[int(c) for c in row] for row in x]
        assert sums == [sum(r[i] for r in own) for i in range(5)]
        assert all(products[i][j] == sum(r[i] * r[j] for r in own) for i in range(5) for j in range(i, 5))
    for total in (0, 1, -1, 2**40, -(2**40) - 1, 7**60, -(7**60)):
        assert sum(v << (whitening.LIMB * k) for k, v in enumerate(whitening.limbs(total))) == total


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema)).orderBy("vec_id", "component").collect()
    assert make([]) == [] and make([(1, None), (2, [float("nan")])]) == []
    one = make([(1, [0.5, 0.25]), (2, [0.5, 0.25])])  # one distinct vector: no spread
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(v, c, 1, 0, None, None) for v in (1, 2) for c in (1, 2)]
    line = make([(k, [k / 4, -k / 4]) for k in range(5)])  # the second eigenvalue is 0
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-9
    assert abs(line[0].explained - 1) < 1e-12 and abs(line[1].explained) < 1e-12
    huge = make([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1.0, 1.0])])  # beyond 64 bits: the nearest entry, no deviation
    assert [r.deviation for r in huge] == [None] * 4 + [513**2 + 256**2] * 2


# --- op13


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_by_hand(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grow(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, k):
    out = []
    for nodes in levels[:-1]:
        a = k // 3 * 3
        out.append((nodes[a:k], nodes[k + 1 : a + 3]))
        k //= 3
    return out


def manifest_by_hand(table):
    """table: (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for r in table:
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        claim = leaf_by_hand([*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]])
        by[r[1]].append((r[0] is not None, r[0], leaf_by_hand(r), claim))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: (x[0], str(x[1]) if isinstance(x[1], str) else x[1] or 0, x[2]))
        trees[s] = grow([x[2] for x in by[s]])
    top = grow([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for k, (_, i, leaf, claim) in enumerate(by[s]):
            steps = siblings(trees[s], k) + siblings(top, j)
            folded = claim
            for a, b in steps:
                folded = digest("".join(a) + folded + "".join(b))
            root = top[-1][0]
            out.append((i, leaf, trees[s][-1][0], root, digest("".join(x for a, b in steps for x in a + b)), folded, folded == root))
    return sorted(out, key=str)


def manifest(df, **more):
    m = merkle.manifest(df, claimed=merkle.without_line_ends(), **more)
    return sorted([tuple(r) for r in m.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


def as_table(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(spark, rows, levels):
    """Trees of many and of one superblock, sources of one leaf, null ids, ids beyond 53 bits beside them, repeated rows."""
    df = documents(spark, rows + [(i, f"t\n{i}", "big") for i in range(100, 188)] + [rows[9]])
    want = manifest_by_hand(as_table(df))
    assert manifest(df, levels=levels) == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_little(spark):
    assert manifest(documents(spark, [])) == []
    one = documents(spark, [(7, None, None)])
    assert manifest(one) == manifest_by_hand(as_table(one)) and manifest(one)[0][1] == manifest(one)[0][3]
    named = documents(spark, [(f"d{i}", "a\nb", f"s{i}") for i in range(29)], DOCS.replace("doc_id long", "doc_id string"))
    assert manifest(named, levels=1) == manifest_by_hand(as_table(named))


def test_manifest_output_can_be_verified_alone(spark, rows):
    """A holder of a leaf, its proof's steps and the root needs nothing else."""
    df = documents(spark, rows)
    honest = merkle.manifest(df).collect()
    assert all(r.verified and r.folded_root == r.root and merkle._hash(r.proof) == r.proof_sha256 for r in honest)
    forged = merkle.manifest(df, claimed={"lang": F.lit("xx")}).where("verified").count()
    assert forged == 0
