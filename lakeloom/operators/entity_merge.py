"""Merging of new entities into a stored set, batch by batch, with work that goes with the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans.components import connected_components
from lakeloom.session import materialize
from lakeloom.sources.keyed import KeyedTable, logged


class EntityStore:
    """Entities under aliases. A group of names that alias pairs join is one entity, called by its least name.

    ``labels`` has each name's group, ``members`` the same by group, ``entities`` the merged record
    of each group: its longest description (the first in code-point order on ties), all its chunk
    ids, and how many records went in. Ten batches give what one batch of all of them gives.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path = spark, path
        self.labels = KeyedTable(spark, f"{path}/labels", "name string, label string", ["name"], buckets)
        self.members = KeyedTable(spark, f"{path}/members", "label string, name string", ["label"], buckets)
        self.entities = KeyedTable(spark, f"{path}/entities", "label string, description string, chunk_ids array<string>, records long", ["label"], buckets)

    @staticmethod
    def _merged(records: DataFrame) -> DataFrame:
        first = F.struct((-F.length("description")).alias("n"), F.col("description").alias("d"))
        return records.groupBy("label").agg(F.min_by("description", first).alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("chunk_ids"), F.sum("records").alias("records"))

    def _changes(self, records: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
        """The new rows of all three tables. Only names of the batch and groups that it joins are read."""
        records = materialize(records.where("name IS NOT NULL").select("name", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids")), "entity-records")
        aliases = materialize(aliases.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct(), "entity-aliases")
        names = materialize(records.select("name").unionByName(aliases.select(F.explode(F.array("a", "b")).alias("name"))).distinct(), "entity-names")
        known = names.join(self.labels.lookup(names), "name", "left").select("name", F.coalesce("label", "name").alias("old"), F.col("label").isNull().alias("new"))
        known = materialize(known, "entity-known")

        # the groups that the batch joins, found on groups in place of names
        ends = aliases.join(known.select(F.col("name").alias("a"), F.col("old").alias("x")), "a").join(known.select(F.col("name").alias("b"), F.col("old").alias("y")), "b")
        parts = connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct())
        parts = materialize(parts.select(F.col("id").alias("old"), F.col("component").alias("label")), "entity-parts")
        moved = parts.where("old <> label")

        fresh = known.where("new").join(parts, "old", "left").select("name", F.coalesce("label", "old").alias("label"))
        carried = self.members.lookup(moved.select(F.col("old").alias("label"))).withColumnRenamed("label", "old").join(moved, "old").select("name", "label")
        named = materialize(fresh.unionByName(carried).distinct(), "entity-named")  # all names that get a group or another one
        grown = named.select("label").distinct()
        whole = self.members.lookup(grown).unionByName(named.select("label", "name")).distinct()

        mine = records.join(known.select("name", "old"), "name").join(parts, "old", "left").select(F.coalesce("label", "old").alias("label"), "description", "chunk_ids", F.lit(1).cast("long").alias("records"))
        mine = materialize(mine, "entity-mine")
        touched = mine.select("label").unionByName(parts.select(F.col("old").alias("label"))).distinct()
        stored = self.entities.lookup(touched).withColumnRenamed("label", "old").join(parts, "old", "left").select(F.coalesce("label", "old").alias("label"), "description", "chunk_ids", "records")
        merged = self._merged(stored.unionByName(mine))
        lost = moved.select(F.col("old").alias("label")).distinct()
        gone = F.lit(True).alias("gone")
        return {
            "labels": named.withColumn("gone", F.lit(False)),
            "members": whole.withColumn("gone", F.lit(False)).unionByName(lost.select("label", F.lit("").alias("name"), gone)),
            "entities": merged.withColumn("gone", F.lit(False)).unionByName(lost.select("label", F.lit("").alias("description"), F.array().cast("array<string>").alias("chunk_ids"), F.lit(0).cast("long").alias("records"), gone)),
        }

    def merge(self, records: DataFrame, aliases: DataFrame, batch: int | str) -> dict[str, int]:
        """Take in records(name, description, chunk_ids) and aliases(a, b); a batch id that came last before does nothing.

        Returns the buckets that each table had written anew. A batch that died half way is taken
        up where it stopped. Null names go; null descriptions are empty.
        """
        changes = logged(self.spark, f"{self.path}/log", f"b{batch}", lambda: self._changes(records, aliases))
        return {n: getattr(self, n).replace(df, f"b{batch}") for n, df in changes.items()}
