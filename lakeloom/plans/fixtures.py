"""Knowledge-base tables derived from the supplied ones, as plans and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.text import sha32
from lakeloom.plans.registry import Tables


def entities(t: Tables) -> DataFrame:
    e = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return e.select(
        sha32(F.col("n_name")).alias("node_id"), F.col("n_name").alias("node_name"), F.lit("nation").alias("type"),
        F.col("r_name").alias("sub_type"), F.concat("n_name", F.lit(" in "), "r_name").alias("description"),
    )


ENTITIES = """ent AS (SELECT substr(sha256(n_name), 1, 32) AS node_id, n_name AS node_name, 'nation' AS type, r_name AS sub_type,
  n_name || ' in ' || r_name AS description FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def edges(t: Tables) -> DataFrame:
    """Customers and suppliers to nations, nations to regions."""
    n = t.nation
    c = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_name").alias("node1"), F.col("n_name").alias("node2"), F.col("c_mktsegment").alias("keywords"), F.lit(1.0).alias("weight"), F.lit("customer").alias("source_id")
    )
    s = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", "n_name", F.lit("supplies"), F.lit(2.0), F.lit("supplier"))
    r = n.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", F.lit("part of"), F.lit(1.0), F.lit("nation"))
    return c.union(s).union(r)


EDGES = """edges AS (
  SELECT c_name AS node1, n_name AS node2, c_mktsegment AS keywords, 1.0::DOUBLE AS weight, 'customer' AS source_id FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT s_name, n_name, 'supplies', 2.0, 'supplier' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, r_name, 'part of', 1.0, 'nation' FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def bridge(t: Tables) -> DataFrame:
    """(cluster_id, chunk_id, url): each document belongs to the cluster of a nation."""
    d = t.documents.select("doc_id", "source", (F.col("doc_id") % 25).cast("int").alias("n_nationkey"))
    b = d.join(t.nation, "n_nationkey")
    return b.select(sha32(F.col("n_name")).alias("cluster_id"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("url"))


BRIDGE = """bridge AS (SELECT substr(sha256(n_name), 1, 32) AS cluster_id, doc_id AS chunk_id, source AS url
  FROM documents JOIN nation ON n_nationkey = (doc_id % 25)::INTEGER)"""


def history(t: Tables) -> DataFrame:
    """Events as a memory's history: one memory a user, the event type as its new value."""
    kind = F.when(F.col("event_type") == "purchase", "DELETE").when(F.col("event_type") == "view", "UPDATE").otherwise("ADD")
    return t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("memory_id"), kind.alias("event"), F.col("event_type").alias("new_memory"), F.col("ts").alias("created_at"))


HISTORY = """history AS (SELECT event_id AS id, user_id AS memory_id,
  CASE WHEN event_type = 'purchase' THEN 'DELETE' WHEN event_type = 'view' THEN 'UPDATE' ELSE 'ADD' END AS event,
  event_type AS new_memory, ts AS created_at FROM events)"""


def query_vector(t: Tables, vec_id: int = 0) -> DataFrame:
    return t.embeddings.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


#: Terms of the example search, and the DuckDB expressions for a search token list and BM25.
SEARCH = ("ation", "the", "worthless")
TERMS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def bm25_cte(words: tuple[str, ...] = SEARCH, where: str = "matched > 0") -> str:
    n = range(len(words))
    tf = ", ".join(f"len(list_filter(tm, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in n)
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.5 / (tf{i} + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))" for i in n)
    matched = " + ".join(f"(tf{i} > 0)::INT" for i in n)
    return f"""tk AS (SELECT doc_id, {TERMS} AS tm FROM documents), tf AS (SELECT doc_id, len(tm) AS dl, {tf} FROM tk),
  one AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM tf),
  bm25 AS (SELECT * FROM (SELECT doc_id, round({score}, 6) AS score, {matched} AS matched FROM tf, one) WHERE {where})"""
