"""Mutual best merges of vectors by short lists of partners in place of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import blocks, dedup


def test_hash_and_rounding_are_sparks(spark):
    rng = np.random.default_rng(1)
    lo, hi = rng.integers(-(2**62), 2**62, 200), rng.integers(0, 1000, 200)
    c = np.concatenate([rng.uniform(-1, 1, 190), [0.1234565, -0.1234565, 0.0000005, 0.3, 1.0, 0.9999995, 0.2999995, 0.29999949999999997, np.nan, 0.5]])
    rows = spark.createDataFrame([(int(a), int(b), float(x)) for a, b, x in zip(lo, hi, c, strict=True)], "lo long, hi long, c double").select(F.xxhash64("lo", "hi"), F.round("c", 6)).collect()
    assert [r[0] for r in rows] == blocks.pair_hash(lo, hi).tolist()
    np.testing.assert_array_equal([r[1] for r in rows], blocks._six(c))


@pytest.mark.parametrize("k, one_task", [(2, 0), (3, 20), (64, 20_000)])
def test_lists_merge_as_all_pairs_do(spark, monkeypatch, k, one_task):
    """Copies, near copies, odd vectors and null labels: the outcome is that of all pairs, and no vector brings more than k of them."""
    monkeypatch.setattr(dedup, "ONE_TASK", one_task)
    monkeypatch.setattr(blocks, "STRIP", 7)
    rng = np.random.default_rng(k)
    centre = rng.normal(size=(4, 3))
    rows = [(i, (centre[i % 4] + rng.normal(size=3) * 0.1).tolist(), i % 2) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0], 0) for i in range(21)]
    rows += [(200, [0.0, 0.0, 0.0], 0), (201, None, 0), (202, [1.0, None, 3.0], 0), (203, [1.0, 2.0, 3.0], None), (204, [1.0, 2.0], 0), (None, [1.0, 2.0, 3.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    lists = []
    monkeypatch.setattr(dedup, "nearest_within", lambda *a: lists.append(blocks.nearest_within(*a)) or lists[-1])
    got = [tuple(r) for r in dedup.mutual_best_vectors(df, "label", 0.3, k).collect()]
    assert sorted(got) == sorted(tuple(r) for r in dedup.mutual_best_merge(dedup.similar_pairs(df, "label", 0.3)).collect())
    assert len(got) > 30 and lists
    assert dedup.mutual_best_vectors(df.where("vec_id < 0"), "label", 0.3, k).count() == 0


def test_lists_are_short(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(300)], "vec_id long, embedding array<double>, label int")
    side = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    assert blocks.nearest_within(side, 4, 0.3, ["label"]).count() == 300 * 4
