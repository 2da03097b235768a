"""Connected components of an edge table, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.session import discard, materialize


def _mark(e: DataFrame) -> tuple:
    """Count and order-free hash of an edge table, to tell whether a round changed it."""
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.min("a"), F.max("b")).first())


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component) for every vertex of edges(a, b); component is the smallest id reachable.

    Alternates large-star and small-star steps: the number of edges never grows and the
    longest label path shrinks geometrically, so a few rounds suffice even for long chains.
    Nulls and self-loops are dropped; an empty table gives an empty result. Each round is cut
    off by a table in the shared folder; only one counter reaches the driver.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    if e.isEmpty():
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    mark = _mark(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        new = (
            small.select(F.col("a"), F.col("m").alias("b"))
            .unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        new = materialize(new, "cc")
        discard(e)
        e, before, mark = new, mark, _mark(new)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    star = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    roots = star.select(F.col("component").alias("id"), "component").distinct()
    return star.unionByName(roots).distinct()
