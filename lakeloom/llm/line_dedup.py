"""Line dedup: lines that many documents share stay in one of them only.

Lines are exploded with their positions, normalised and hashed; distinct documents are counted
for each hash; what is over the threshold is dropped and texts are put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import ascii_lower
from lakeloom.session import materialize

#: What is stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _digest(text: Column) -> Column:
    """Tells apart rows of one doc_id that have different texts."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_lines, n_dropped, text (what is kept).

    A key of min_chars code points or more that min_docs documents or more hold loses all its
    lines except those in the document of the largest doc_id; there every line of it stays. Keys
    are compared by the first 128 bits of their sha256. A document is a doc_id: rows of one id are
    counted as one, each is returned, and rows with a null id are one document, less than any other. A null or empty text is one empty line. Other columns are ignored; an empty table
    gives no rows.

    Lines leave the scan as (id, digest, position, hash) without their text. The count has two
    levels, so a line that a third of all documents hold is summed in every task first; the join
    with the counts is one that Spark can split. Texts are shuffled once, to meet their positions.
    """
    # the key is projected before the filter uses it, and hashed only after
    exploded = docs.select("doc_id", F.col("text").alias("_text")).select("doc_id", _digest(F.coalesce("_text", F.lit(""))).alias("digest"), F.posexplode(_lines(F.col("_text"))).alias("pos", "line"))
    long = exploded.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    lines = materialize(long.select("doc_id", "digest", "pos", F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("hash")), "lines")
    holders = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    counts = lines.groupBy("hash").agg(holders.alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    counts = materialize(counts.select("hash", "keeper"), "frequent-lines")
    gone = lines.join(counts, "hash").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("of")).agg(F.collect_set("pos").alias("gone"))

    whole = docs.select("doc_id", F.col("text").alias("_text")).select("doc_id", _digest(F.coalesce("_text", F.lit(""))).alias("digest"), _lines(F.col("_text")).alias("lines"))
    out = whole.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest.a") == F.col("of.a")) & (F.col("digest.b") == F.col("of.b")), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))  # in order, in time linear in the lines
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.get("lines", i)))
    dropped = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(dropped).alias("n_dropped"), F.array_join(kept, "\n").alias("text"))


def line_dedup_sql(min_chars: int = 40, min_docs: int = 5) -> str:
    """The same for DuckDB, with a digest in place of the text."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
  k AS (SELECT *, translate(trim(line, {blanks}), '{upper}', '{lower}') AS key FROM l),
  c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
  m AS (SELECT k.*, coalesce(doc_id <> keeper, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
