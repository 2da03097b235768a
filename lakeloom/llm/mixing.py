"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents are dealt into key ranges,
prefix sums of word counts run first over the ranges and then inside each range, and the mix is
cut at the source's exact budget after as many whole epochs as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.common import n_words

#: Targets stop at this multiple of their source's size.
MAX_EPOCHS = 3
#: Rows a key range holds on average; ranges grow in number with the largest source.
RANGE_ROWS = 1_000


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, cycle: int = 3) -> DataFrame:
    """(no_source, src, source_size) -> the same with weight and target.

    Sources in code-point order, null last, weigh 1, 2, ..., cycle, repeating, and share the
    total size by weight. A share over max_epochs times its source stops there and the excess is
    dealt again by weight. With caps sorted by cap / weight the stopped sources are a prefix, so
    one running sum over the (small) table of sources finds all of them at once: source i stops
    if what is left times its weight exceeds its cap times the weights left.
    """
    order = W.orderBy("no_source", "src")
    s = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    every = W.partitionBy()
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "no_source", "src").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
    s = s.withColumn("weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
    s = s.withColumn("stops", F.col("left") * F.col("weight") >= F.col("cap") * F.col("weights"))
    s = s.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(every), F.lit(0)))
    s = s.withColumn("open", F.sum(F.when(~F.col("stops"), F.col("weight"))).over(every))
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(
        (F.col("rest") * F.col("weight")).cast("double") / F.col("open").cast("double")
    )
    return s.withColumn("target", target).select("no_source", "src", "source_size", "weight", "target")


def mix_sources(docs: DataFrame, size: Column | None = None, ranges: int | None = None) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, source, size, source_size, target, taken.

    size defaults to the number of words. taken is what the mix takes of a document: whole
    epochs times its size, and in the last epoch what lies before the budget's cut, so the
    document at the cut is taken in part and a source's taken words are its target rounded down.
    Null sources form one source, the last; null and empty texts have size 0 and take 0; a null
    doc_id is keyed like an empty one; ties in the key go by doc_id and size, and rows equal in
    all of these are interchangeable. Other columns are ignored. An empty table gives no rows.
    """
    d = docs.select(
        F.col("doc_id"),
        F.col("source"),
        (n_words(F.col("text")) if size is None else size).alias("size"),
    )
    d = d.select(
        "doc_id", "source", "size",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("src"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
    )
    if ranges is None:
        most = docs.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        ranges = max(1, min(65536, most // RANGE_ROWS + 1))
    d = d.withColumn("rng", F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("long") * ranges / 65536))
    by_range = d.groupBy("no_source", "src", "rng").agg(F.sum("size").alias("range_size"))
    before = W.partitionBy("no_source", "src").orderBy("rng").rowsBetween(W.unboundedPreceding, -1)
    by_range = by_range.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    sizes = d.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"))
    by_range = by_range.join(source_targets(sizes), ["no_source", "src"])
    inside = W.partitionBy("no_source", "src", "rng").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(by_range, ["no_source", "src", "rng"])
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    last = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), last - F.col("before") - F.col("inside")))
    return d.select(
        "doc_id", "source", "size", "source_size", "target",
        (epochs * F.col("size") + part).cast("long").alias("taken"),
    )


def mixing_sql(docs: str = "documents", columns: str = "doc_id, size, source_size, target, taken") -> str:
    """The same rows in DuckDB."""
    return rf"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM {docs}),
s0 AS (SELECT no_source, src, sum(size)::HUGEINT AS source_size FROM d GROUP BY ALL),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1)::HUGEINT AS weight, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () AS total,
         sum(source_size) OVER () - coalesce(sum(cap) OVER r, 0) AS rest0, sum(weight) OVER () - coalesce(sum(weight) OVER r, 0) AS weights
       FROM s1 WINDOW r AS (ORDER BY cap::DOUBLE / weight, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, rest0 * weight >= cap * weights AS stops FROM s2),
s4 AS (SELECT *, total - coalesce(sum(CASE WHEN stops THEN cap END) OVER (), 0) AS rest, sum(CASE WHEN NOT stops THEN weight END) OVER () AS open FROM s3),
s AS (SELECT no_source, src, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE (rest * weight)::DOUBLE / open::DOUBLE END AS target FROM s4),
p AS (SELECT d.*, source_size::BIGINT AS source_size, target, floor(target)::BIGINT AS budget,
        coalesce(sum(size) OVER (PARTITION BY no_source, src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN s USING (no_source, src)),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT {columns} FROM (SELECT *, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM q)
"""
