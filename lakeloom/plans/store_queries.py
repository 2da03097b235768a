"""Queries of stored structures: the vector and the full-text index, chunks cut anew by source, a graph that follows its documents, entities merged batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakeloom.functions.text import terms
from lakeloom.operators.entity_merge import EntityStore
from lakeloom.operators.graph_store import GraphStore
from lakeloom.operators.rechunking import rechunk, rechunk_sql
from lakeloom.operators.text_index import TextIndex
from lakeloom.operators.vector_index import VectorIndex
from lakeloom.plans import fixtures as X
from lakeloom.plans.registry import Tables, query
from lakeloom.session import materialize, shared_dir
from lakeloom.streaming.history import file_stream, run_available


def fresh(t: Tables, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def every_hundredth(t: Tables):
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


EXACT = """SELECT qid, vec_id AS id, score, rank FROM (SELECT a.vec_id AS qid, b.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= {0}"""


@query("j9_index_topk")
def _(t: Tables):
    """Approximate, with as many lists as a sample of the queries needs for a recall of 0.95. Tests hold it against the full scan."""
    index = VectorIndex.train(t.spark, fresh(t, "index"), t.embeddings)
    index.insert(t.embeddings)
    return index.search(every_hundredth(t), 10, nprobe=index.tune(every_hundredth(t), 10))


@query("j9_index_exact", EXACT.format(10))
def _(t: Tables):
    """The same index, with bounds from radii and coding errors in place of a fixed number of lists."""
    index = VectorIndex.train(t.spark, fresh(t, "index"), t.embeddings)
    index.insert(t.embeddings)
    return index.search(every_hundredth(t), 10, nprobe=8, exact=True)


@query("m22_index_insert", EXACT.format(5))
def _(t: Tables):
    """Fitted on a third of the table; the rest comes in two batches, one of them twice."""
    part = lambda k: t.embeddings.where(F.col("vec_id") % 3 == k)
    index = VectorIndex.train(t.spark, fresh(t, "index"), part(0))
    for batch in (0, 1, 2, 1):
        index.insert(part(batch), batch)
    return index.search(every_hundredth(t), 5, nprobe=4, exact=True)


@query("c5_rechunk", rechunk_sql(1024, 50))
def _(t: Tables):
    d = t.documents.select("source", F.col("doc_id").alias("ord"), F.col("doc_id").alias("chunk_id"), "text", F.lit(None).cast("array<string>").alias("source_chunk"))
    new = rechunk(d)
    return new.select("source", "token_start", "token_end", "chunk_id", F.size("source_chunk").cast("long").alias("n_sources"), F.sha2(F.array_join("source_chunk", ","), 256).alias("sources_sha256"))


def _extraction(t: Tables) -> tuple:
    """Chunks, records and edges as an extractor would give them: an order is a document, each of its lines a chunk that names a part and a supplier."""
    l = t.lineitem.withColumn("chunk", F.concat_ws("-", "l_orderkey", "l_linenumber"))  # noqa: E741
    part, supplier = F.concat(F.lit("part "), "l_partkey"), F.concat(F.lit("supplier "), "l_suppkey")
    chunks = l.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("chunk").alias("chunk_id"))
    pos = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")
    nodes = l.where("l_quantity < 40").select(part.alias("name"), F.col("l_returnflag").alias("type"), F.concat("l_linestatus", F.lit(" at "), F.col("l_quantity").cast("long")).alias("description"), F.col("chunk").alias("source_id"), pos)
    edges = l.select(part.alias("node1"), supplier.alias("node2"), F.concat_ws(",", "l_returnflag", "l_linestatus").alias("keywords"), F.col("l_quantity").alias("weight"), F.concat(F.lit("line "), "l_linenumber").alias("description"), F.col("chunk").alias("source_id"))
    return chunks, nodes, edges


_LEFT = """l AS (SELECT *, l_orderkey || '-' || l_linenumber AS chunk, 'part ' || l_partkey AS part, 'supplier ' || l_suppkey AS supplier FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 9 = 0)),
  r AS (SELECT part AS name, l_returnflag AS type, l_linestatus || ' at ' || l_quantity::BIGINT AS description, chunk, l_orderkey * 10 + l_linenumber AS pos FROM l WHERE l_quantity < 40)"""
_SET = "array_to_string(list_sort(list_distinct(list({0}))), '<SEP>')"


@query("g6_delete_rebuild", f"""WITH {_LEFT}, k AS (SELECT name, type, count(*) AS n, min(pos) AS first FROM r GROUP BY ALL),
  best AS (SELECT name, type FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, first) AS rn FROM k) WHERE rn = 1),
  own AS (SELECT name, any_value(best.type) AS type, {_SET.format("description")} AS description, {_SET.format("chunk")} AS source_id FROM r JOIN best USING (name) GROUP BY name),
  e AS (SELECT part AS name, 'line ' || l_linenumber AS d, chunk FROM l UNION ALL SELECT supplier, 'line ' || l_linenumber, chunk FROM l)
  SELECT name, NULL AS other, type AS label, NULL::DOUBLE AS weight, sha256(description) AS description, sha256(source_id) AS sources FROM own
  UNION ALL SELECT name, NULL, 'UNKNOWN', NULL, sha256({_SET.format("d")}), sha256({_SET.format("chunk")}) FROM e WHERE name NOT IN (SELECT name FROM own) GROUP BY name
  UNION ALL SELECT part, supplier, array_to_string(list_sort(list_distinct(flatten(list([l_returnflag, l_linestatus])))), ','), sum(l_quantity),
    sha256({_SET.format("'line ' || l_linenumber")}), sha256({_SET.format("chunk")}) FROM l GROUP BY part, supplier""")
def _(t: Tables):
    """Entities and relations of a graph of all orders, after those whose customer's key is a multiple of 9 were deleted."""
    store = GraphStore(t.spark, fresh(t, "graph"), 16, keep=1)
    store.ingest("add", *_extraction(t))
    store.delete_documents("delete", t.orders.where("o_custkey % 9 = 0").select(F.col("o_orderkey").cast("string").alias("doc_id")))
    digests = [F.sha2("description", 256).alias("description"), F.sha2("source_id", 256).alias("sources")]
    entities = store.entities.read().select("name", F.lit(None).cast("string").alias("other"), F.col("type").alias("label"), F.lit(None).cast("double").alias("weight"), *digests)
    return entities.unionByName(store.relations.read().select(F.col("a").alias("name"), F.col("b").alias("other"), F.col("keywords").alias("label"), "weight", *digests))


def _alias_batches(t: Tables):
    """Customers under the name of their key; a customer is an alias of the one 25 keys before in the same segment."""
    c = t.customer.select("*", F.format_string("c%08d", "c_custkey").alias("name"), F.format_string("c%08d", F.col("c_custkey") - 25).alias("before"))
    old = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))
    pairs = c.join(old, (F.col("c_custkey") - 25 == F.col("k")) & (F.col("c_mktsegment") == F.col("s"))).select(F.col("name").alias("a"), F.col("before").alias("b"))
    records = c.select("name", F.concat("c_mktsegment", F.lit(" "), F.round("c_acctbal").cast("long")).alias("description"), F.array(F.concat(F.lit("n"), "c_nationkey")).alias("chunk_ids"))
    return records, pairs


@query("x7_incremental_entities", """WITH c AS (SELECT *, lag(c_mktsegment) OVER (PARTITION BY c_custkey % 25 ORDER BY c_custkey) AS s, lag(c_custkey) OVER (PARTITION BY c_custkey % 25 ORDER BY c_custkey) AS k FROM customer),
  i AS (SELECT *, sum((s IS DISTINCT FROM c_mktsegment OR k IS DISTINCT FROM c_custkey - 25)::INT) OVER (PARTITION BY c_custkey % 25 ORDER BY c_custkey) AS island FROM c),
  g AS (SELECT *, min(c_custkey) OVER (PARTITION BY c_custkey % 25, island) AS least, c_mktsegment || ' ' || round(c_acctbal)::BIGINT AS d FROM i)
  SELECT printf('c%08d', least) AS label, arg_min(d, {'n': -length(d), 'd': d}) AS description, array_to_string(list_sort(list_distinct(list('n' || c_nationkey))), ',') AS chunk_ids, count(*) AS records FROM g GROUP BY least""")
def _(t: Tables):
    """Three files of records and pairs, in no order of their keys, each one batch of a stream."""
    records, pairs = _alias_batches(t)
    store, source = EntityStore(t.spark, fresh(t, "entities"), 16), fresh(t, "batches")
    both = records.select("name", "description", "chunk_ids", F.lit(None).cast("string").alias("b")).unionByName(pairs.select(F.col("a").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<string>").alias("chunk_ids"), "b"))
    both = materialize(both, "batch-rows")
    for k in range(3):
        both.where(F.crc32(F.concat("name", F.coalesce("b", F.lit("")))) % 3 == k).coalesce(1).write.mode("append").parquet(source)

    def each(batch, number: int) -> None:
        store.merge(batch.where("b IS NULL"), batch.where("b IS NOT NULL").select(F.col("name").alias("a"), "b"), number)

    run_available(file_stream(t.spark, source, "name string, description string, chunk_ids array<string>, b string", 1), fresh(t, "checkpoint"), each)
    return store.entities.read().select("label", "description", F.array_join("chunk_ids", ",").alias("chunk_ids"), "records")


@query("f19_bm25_index", f"WITH {X.bm25_cte()} SELECT doc_id, score, matched FROM bm25")
def _(t: Tables):
    """The search of f19_bm25 over a stored index, whose documents came in two batches, one of them twice."""
    index = TextIndex(t.spark, fresh(t, "text-index"), 16)
    for batch in (0, 1, 1):
        index.insert(t.documents.where(F.col("doc_id") % 2 == batch), batch)
    asked = t.spark.createDataFrame([(0, w) for w in X.SEARCH], "qid int, term string")
    return index.search(asked).select(F.col("id").alias("doc_id"), "score", "matched")


@query("f19_bm25_batch", f"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({X.TERMS}) AS term FROM documents) GROUP BY ALL),
  d AS (SELECT doc_id, len({X.TERMS}) AS dl FROM documents), one AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  q AS (SELECT DISTINCT item_id, unnest({X.TERMS}) AS term FROM benchmark),
  s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (doc_id), one GROUP BY item_id, doc_id)
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""")
def _(t: Tables):
    """Every benchmark text as a query, all at once."""
    index = TextIndex(t.spark, fresh(t, "text-index"), 16)
    index.insert(t.documents)
    asked = t.benchmark.select(F.col("item_id").alias("qid"), F.explode(terms(F.col("text"))).alias("term"))
    return index.search(asked, 5).select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")
