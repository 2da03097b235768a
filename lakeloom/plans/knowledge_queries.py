"""Queries of knowledge-base upkeep and of the composite graph-memory modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.vectors import cosine
from lakeloom.operators import graph as G
from lakeloom.operators import retrieval as R
from lakeloom.operators.tables import fill_down
from lakeloom.plans import fixtures as X
from lakeloom.plans.registry import Tables, query
from lakeloom.sources import writers

_COS = "(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))"
_DEG = "deg AS (SELECT node, count(*) AS degree FROM (SELECT node1 AS node FROM edges UNION ALL SELECT node2 FROM edges) GROUP BY node)"
# entities of the graph memory: a nation has the vector of its key
_NODES = f"q AS (SELECT b.vec_id AS id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0), hit AS (SELECT n_name AS node, score FROM q JOIN nation ON n_nationkey = id ORDER BY score DESC, node LIMIT 5)"


def _hits(t: Tables):
    v = t.embeddings.crossJoin(F.broadcast(X.query_vector(t)))
    v = v.select(F.col("vec_id").cast("int").alias("n_nationkey"), F.round(cosine("embedding", "q"), 6).alias("score"))
    return R.top_k(v.join(t.nation, "n_nationkey").select(F.col("n_name").alias("node"), "score"), 5, F.desc("score"), F.col("node"))


@query("r7_memory_local", f"WITH {X.EDGES}, {_DEG}, {_NODES} SELECT node1, node2, x.degree + y.degree AS rank FROM edges JOIN deg x ON x.node = node1 JOIN deg y ON y.node = node2 WHERE node1 IN (SELECT node FROM hit) OR node2 IN (SELECT node FROM hit)")
def _(t: Tables):
    return G.one_hop(G.edge_ranks(X.edges(t)), _hits(t).select("node")).select("node1", "node2", "rank")


@query("r8_memory_global", f"""WITH {X.EDGES}, r AS (SELECT node1, node2, weight, row_number() OVER (ORDER BY weight DESC, node1, node2) AS pos FROM edges), c AS (SELECT * FROM r WHERE pos <= 10),
  u AS (SELECT pos * 2 AS p, node1 AS node FROM c UNION ALL SELECT pos * 2 + 1, node2 FROM c) SELECT node, row_number() OVER (ORDER BY min(p)) AS pos FROM u GROUP BY node""")
def _(t: Tables):
    top = R.top_k(X.edges(t).select("node1", "node2", "weight"), 10, F.desc("weight"), F.col("node1"), F.col("node2"))
    ranked = top.select("node1", "node2", F.row_number().over(R.W.orderBy(F.desc("weight"), "node1", "node2")).alias("pos"))
    return G.endpoints(ranked)


@query("r6_memory_naive", """WITH s AS (SELECT doc_id, n_chars AS tokens, row_number() OVER (ORDER BY n_chars, doc_id) AS pos FROM documents WHERE n_chars > 100), k AS (SELECT * FROM s WHERE pos <= 20)
  SELECT doc_id, pos FROM (SELECT *, sum(tokens) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM k) WHERE used <= 3000""")
def _(t: Tables):
    top = R.top_k(t.documents.where("n_chars > 100").select("doc_id", F.col("n_chars").alias("tokens")), 20, F.col("tokens"), F.col("doc_id"))
    top = top.withColumn("pos", F.row_number().over(R.W.orderBy("tokens", "doc_id")))  # twenty rows
    return R.token_budget(top, 3000).select("doc_id", "pos")


@query("p7_table_nodes", f"WITH {X.ENTITIES} SELECT node_name FROM ent WHERE sub_type = 'AMERICA'")
def _(t: Tables):
    return X.entities(t).where("sub_type = 'AMERICA'").select("node_name")


@query("j20_neighbour_pages", "SELECT a.page_id AS image, b.page_id AS page FROM pages a JOIN pages b ON b.page_id BETWEEN a.page_id - 1 AND a.page_id + 1")
def _(t: Tables):
    near = t.pages.select(F.col("page_id").alias("image"), F.explode(F.array(F.col("page_id") - 1, "page_id", F.col("page_id") + 1)).alias("page"))
    return near.join(t.pages.select(F.col("page_id").alias("page")), "page")


@query("k3_entity_rows", f"WITH {X.ENTITIES} SELECT node_id, node_name, 'attr' AS type, sub_type, description FROM ent")
def _(t: Tables):
    return writers.entity_rows(X.entities(t))


@query("k12_unknown_endpoints", "SELECT n_name AS name, 'UNKNOWN' AS kind FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT n_name, 'nation' FROM nation WHERE n_nationkey % 2 = 0")
def _(t: Tables):
    known = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    ends = t.nation.select(F.col("n_name").alias("name")).distinct()
    return known.unionByName(ends.join(known, "name", "left_anti").withColumn("kind", F.lit("UNKNOWN")))


@query("k10_csv_lines", "SELECT n_nationkey, n_nationkey || ',' || n_name || ',\"' || n_name || ', x\"' AS line FROM nation")
def _(t: Tables):
    n = t.nation.select("n_nationkey", "n_name", F.concat("n_name", F.lit(", x")).alias("note"))
    return n.select("n_nationkey", F.to_csv(F.struct("n_nationkey", "n_name", "note")).alias("line"))


@query("m6_chunk_with_vector", "SELECT doc_id, vec_id IS NOT NULL AS has_vector FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE doc_id IN (3, 4, 800)")
def _(t: Tables):
    d = t.documents.where(F.col("doc_id").isin(3, 4, 800)).select("doc_id")
    v = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("v"))
    return d.join(v, "doc_id", "left").select("doc_id", F.coalesce("v", F.lit(False)).alias("has_vector"))


@query("m7_cluster_lists", f"WITH {X.BRIDGE} SELECT cluster_id, count(*) AS n, list(chunk_id ORDER BY chunk_id) AS chunks FROM bridge GROUP BY cluster_id")
def _(t: Tables):
    g = X.bridge(t).groupBy("cluster_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("chunk_id")).alias("chunks"))
    return g.select("cluster_id", "n", "chunks")


@query("m8_chunk_sources", "SELECT doc_id, source FROM documents WHERE source <> ''")
def _(t: Tables):
    return t.documents.where("source <> ''").select("doc_id", "source")


@query("m10_rechunk_rows", "SELECT sha256(text) AS chunk_id, doc_id FROM documents WHERE text <> '' AND doc_id IS NOT NULL")
def _(t: Tables):
    return t.documents.where("text <> '' AND doc_id IS NOT NULL").select(F.sha2("text", 256).alias("chunk_id"), "doc_id")


@query("m16_multihop_union", "WITH u AS (SELECT doc_id % 50 AS id, 0 AS hop, doc_id AS pos FROM documents UNION ALL SELECT item_id, 1, item_id FROM benchmark) SELECT id, first(hop ORDER BY hop, pos) AS hop FROM u GROUP BY id")
def _(t: Tables):
    a = t.documents.select((F.col("doc_id") % 50).alias("id"), F.lit(0).alias("hop"), F.col("doc_id").alias("pos"))
    u = a.unionByName(t.benchmark.select(F.col("item_id").alias("id"), F.lit(1).alias("hop"), F.col("item_id").alias("pos")))
    return R.first_occurrence(u, "id", "hop", "pos").select("id", "hop")


@query("m16_multihop_union_whole", "WITH u AS (SELECT doc_id AS id, 0 AS hop, doc_id AS pos FROM documents UNION ALL SELECT item_id, 1, item_id FROM benchmark) SELECT id, first(hop ORDER BY hop, pos) AS hop FROM u GROUP BY id")
def _(t: Tables):
    a = t.documents.select(F.col("doc_id").alias("id"), F.lit(0).alias("hop"), F.col("doc_id").alias("pos"))
    u = a.unionByName(t.benchmark.select(F.col("item_id").alias("id"), F.lit(1).alias("hop"), F.col("item_id").alias("pos")))
    return R.first_occurrence(u, "id", "hop", "pos").select("id", "hop")


@query("m20_task_queries", "SELECT n_nationkey AS task_id, CASE WHEN n_nationkey % 4 = 0 THEN 'model text ' || n_nationkey ELSE 'What is the size of ' || n_name || '?' END AS q FROM nation")
def _(t: Tables):
    text = t.nation.where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("task_id"), F.concat(F.lit("model text "), "n_nationkey").alias("text"))
    tasks = t.nation.select(F.col("n_nationkey").alias("task_id"), F.concat(F.lit("What is the size of "), "n_name", F.lit("?")).alias("template"))
    return tasks.join(text, "task_id", "left").select("task_id", F.coalesce("text", "template").alias("q"))


@query("m29_relation_chunks", "SELECT source, doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 1)")
def _(t: Tables):
    chosen = t.embeddings.where("label = 1").select(F.col("vec_id").alias("doc_id"))
    return t.documents.select("source", "doc_id").join(chosen, "doc_id", "left_anti").select("source", "doc_id")


@query("m31_consistency", "SELECT doc_id, quality = 0 AS failed FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(t: Tables):
    return t.labels.join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id", (F.col("quality") == 0).alias("failed"))


@query("m33_docs_by_status", "SELECT doc_id, CASE WHEN quality = 1 THEN 'processed' ELSE 'failed' END AS status FROM labels WHERE quality = 0")
def _(t: Tables):
    s = t.labels.select("doc_id", F.when(F.col("quality") == 1, "processed").otherwise("failed").alias("status"))
    return s.where("status = 'failed'")


@query("m34_entity_info", f"WITH {X.EDGES}, {_DEG}, {X.ENTITIES} SELECT node_name, sub_type, coalesce(degree, 0) AS degree FROM ent LEFT JOIN deg ON node = node_name WHERE node_name LIKE '%1%'")
def _(t: Tables):
    e = X.entities(t).where("node_name LIKE '%1%'").join(G.degrees(X.edges(t)).withColumnRenamed("node", "node_name"), "node_name", "left")
    return e.select("node_name", "sub_type", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("m36_vector_ids", "SELECT n_name, 'ent-' || md5(n_name) AS vid, 'rel-' || md5(n_name || r_name) AS rid, 'rel-' || md5(r_name || n_name) AS rid_back FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t: Tables):
    e = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rel = lambda a, b: F.concat(F.lit("rel-"), F.md5(F.concat(a, b)))
    return e.select("n_name", F.concat(F.lit("ent-"), F.md5("n_name")).alias("vid"), rel("n_name", "r_name").alias("rid"), rel("r_name", "n_name").alias("rid_back"))


@query("m39_page_edit", "SELECT page_id, CASE WHEN (length(html) - length(replace(html, '</body>', ''))) // 7 = 1 THEN 'edited' ELSE 'refused' END AS state FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", F.when(F.regexp_count("html", F.lit("</body>")) == 1, "edited").otherwise("refused").alias("state"))


@query("s16_schema_fill_down", "SELECT p_partkey, last_value(CASE WHEN p_partkey % 4 = 1 THEN p_brand END IGNORE NULLS) OVER (PARTITION BY p_size ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS brand FROM part")
def _(t: Tables):
    p = t.part.select("p_partkey", "p_size", F.when(F.col("p_partkey") % 4 == 1, F.col("p_brand")).otherwise("").alias("brand"))
    return fill_down(p, "p_partkey", ["brand"], ["p_size"]).select("p_partkey", "brand")


@query("s12_text_table", "SELECT coalesce(c_name, '') AS c_name, coalesce(c_acctbal::VARCHAR, '') <> '' AS filled FROM customer")
def _(t: Tables):
    c = t.customer.select("c_name", F.col("c_acctbal").cast("string").alias("b")).na.fill("")
    return c.select("c_name", (F.col("b") != "").alias("filled"))


@query("s21_fact_list", "SELECT event_id FROM events WHERE user_id = 3 ORDER BY event_id LIMIT 100")
def _(t: Tables):
    return t.events.where("user_id = 3").select("event_id").orderBy("event_id").limit(100)
