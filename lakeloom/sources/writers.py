"""Sinks: rolled JSON lines, bulk inserts, upserts and deletes on versioned tables, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.records import markdown_row
from lakeloom.functions.text import clean, terms
from lakeloom.session import children, remove

# How many characters the chunk table's columns hold
CHUNK_LIMITS = {"chunk_id": 128, "content_text": 65000, "source_id": 1000, "source_chunk": 65535}


def write_rolled_jsonl(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    df.write.option("maxRecordsPerFile", rows_per_file).json(path)


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Rows as the chunk table stores them: cut to its limits, with the search tokens beside the text."""
    cols = [clean(F.col(c), n).alias(c) for c, n in CHUNK_LIMITS.items()]
    return chunks.select(*cols, terms(F.col("content_text")).alias("content_tokens"))


def entity_rows(entities: DataFrame) -> DataFrame:
    """Stored entities; the type column is the constant the reference stores."""
    return entities.select("node_id", "node_name", F.lit("attr").alias("type"), "sub_type", "description")


def relation_rows(relations: DataFrame) -> DataFrame:
    """Stored relations; the type column is a constant as well."""
    return relations.select("relation_id", "node1", "node2", F.lit("triple").alias("type"), "relation", "description")


def insert_missing(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing and those of new whose key is not there; of equal new keys one."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], version: str, *ties: str) -> DataFrame:
    """Last write wins: of all rows of a key that with the greatest version, then the greatest of ties."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(version), *[F.desc(c) for c in ties]))
    return existing.unionByName(new).withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def delete(existing: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(ids.select(*keys).distinct(), keys, "left_anti")


def drop_dataset(existing: DataFrame, dataset: str) -> DataFrame:
    return existing.where(F.col("dataset") != dataset)


def export_bridge(bridge: DataFrame, sources: list[str]) -> DataFrame:
    return bridge.where(F.col("url").isin(*sources)).orderBy("url", "cluster_id", "chunk_id")


def pack_attributes(attr: Column, chunk_ids: Column) -> list[Column]:
    """A vector row's attributes as JSON and chunk ids joined by commas."""
    return [F.to_json(attr).alias("attr"), F.array_join(chunk_ids, ",").alias("chunk_ids")]


def index_text(pages: DataFrame) -> DataFrame:
    """(category, text): wiki index lines under their category's heading, by title."""
    g = pages.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("title", "stem"))).alias("p"))
    lines = F.transform("p", lambda x: F.concat(F.lit("- [["), x["stem"], F.lit("]] "), x["title"]))
    return g.select("category", F.concat(F.lit("## "), F.col("category"), F.lit("\n"), F.array_join(lines, "\n")).alias("text"))


def wipe_dataset(spark: SparkSession, folder: str, dataset: str) -> list[str]:
    """Remove a dataset from all tables below a folder: its partition (dataset=...) of shared ones, and tables of its own (name.dataset).

    Returns what was removed. Tables that never held the dataset stay untouched.
    """
    gone = []
    for table in children(spark, folder):
        if table.split(".")[1:] == [dataset]:
            gone.append(table)
        elif f"dataset={dataset}" in children(spark, f"{folder}/{table}"):
            gone.append(f"{table}/dataset={dataset}")
    for path in gone:
        remove(spark, f"{folder}/{path}")
    return sorted(gone)


def export_table(df: DataFrame, path: str, kind: str, *order: str) -> None:
    """Text files of df's rows below path as csv, md (a table) or txt (a line a field, a blank one after each row).

    Rows are sorted by ``order`` across the files, so these read in the order of their names are one
    text; its header is in the first file alone, which an empty table has too. Nulls are empty, and
    in md and txt line breaks inside values are spaces.
    """
    names = df.columns
    if kind == "csv":
        head, line = [",".join(names)], F.to_csv(F.struct(*names), {"nullValue": "", "emptyValue": "", "lineSep": "\n"})
    elif kind in ("md", "txt"):
        flat = [F.regexp_replace(F.coalesce(F.col(n).cast("string"), F.lit("")), r"[\r\n]+", " ") for n in names]
        if kind == "md":
            head, line = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)], markdown_row(*flat)
        else:
            head, line = [], F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), c) for n, c in zip(names, flat)], F.lit(""))
    else:
        raise ValueError(f"no such format: {kind}")
    by = F.struct(*order) if order else F.struct(*names)
    rows = df.select(F.lit(1).alias("at"), by.alias("by"), line.alias("value"))
    first = df.sparkSession.createDataFrame([(i, h) for i, h in enumerate(head)], "i int, value string")
    first = first.select((F.col("i") - len(head)).alias("at"), F.lit(None).cast(rows.schema["by"].dataType).alias("by"), "value")
    rows.unionByName(first).orderBy("at", "by").select("value").write.text(path)


def export_graph(entities: DataFrame, relations: DataFrame, folder: str, kind: str = "csv") -> None:
    """entities(name, ...) and relations(a, b, ...) as files below folder/entities and folder/relations."""
    export_table(entities, f"{folder}/entities", kind, "name")
    export_table(relations, f"{folder}/relations", kind, "a", "b")
