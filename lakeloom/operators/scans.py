"""Prefix sums and overlaps of ranges in groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.session import materialize


def prefix_sums(rows: DataFrame, group: str, order: list[str], value: Column) -> DataFrame:
    """rows with pos (from 0), before (value of the rows before) and total, in the order of a unique key of each group; nulls first.

    The sorted table is cut into ranges, so a group that holds most rows is spread over many.
    Sums of whole ranges come first, a row for each range and group, then those inside a range.
    """
    ranged = rows.withColumn("_value", value).repartitionByRange(*[F.col(c).asc_nulls_first() for c in (group, *order)])
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"), F.sum("_value").alias("_sum"))
    upto, every = W.partitionBy("_group").orderBy("_of"), W.partitionBy("_group")
    sums = sums.select(
        "_group", "_of", (F.sum("_n").over(upto) - F.col("_n")).alias("_rows"), (F.sum("_sum").over(upto) - F.col("_sum")).alias("_left"), F.sum("_sum").over(every).alias("total"),
    )
    inside = W.partitionBy(group, "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    out = ranged.withColumn("_in", F.row_number().over(inside) - 1).withColumn("_upto", F.sum("_value").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    out = out.join(sums, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    out = out.withColumn("pos", F.col("_in") + F.col("_rows")).withColumn("before", F.col("_left") + F.col("_upto") - F.col("_value"))
    return out.drop("_value", "_part", "_group", "_of", "_rows", "_left", "_in", "_upto")


def overlapping(new: DataFrame, old: DataFrame, width: int, group: str = "source") -> DataFrame:
    """Pairs of new(group, s, e, ...) and old(group, os, oe, ...) of a group whose half-open ranges overlap, each once.

    Ranges are dealt into the bins of width that they touch and meet there; a pair counts in the
    bin where its overlap begins; an empty range overlaps one that it lies inside of. Work goes with the overlaps of a bin, not with the group.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / width))).alias("_bin")
    n = new.where("e >= s").select("*", bins("s", "e"))
    o = old.where("oe >= os").select("*", bins("os", "oe"))
    met = n.join(o, [group, "_bin"]).where("oe > s AND os < e")
    return met.where(F.floor(F.greatest("s", "os") / width) == F.col("_bin")).drop("_bin")
