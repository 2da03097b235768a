"""Queries of graph, merge, set and deduplication operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.text import sanitize, sha32, split_markers
from lakeloom.operators import dedup as D
from lakeloom.operators import graph as G
from lakeloom.operators.retrieval import first_occurrence, top_k
from lakeloom.plans import fixtures as X
from lakeloom.plans.registry import Tables, query
from lakeloom.sources.html import hrefs

_DEG = "deg AS (SELECT node, count(*) AS degree FROM (SELECT node1 AS node FROM edges UNION ALL SELECT node2 FROM edges) GROUP BY node)"


@query("a16_degrees", f"WITH {X.EDGES}, {_DEG} SELECT * FROM deg")
def _(t: Tables):
    return G.degrees(X.edges(t))


@query("a17_edge_rank", f"WITH {X.EDGES}, {_DEG} SELECT node1, node2, a.degree + b.degree AS rank FROM edges JOIN deg a ON a.node = node1 JOIN deg b ON b.node = node2")
def _(t: Tables):
    return G.edge_ranks(X.edges(t)).select("node1", "node2", "rank")


@query("t4_edges_by_rank", f"WITH {X.EDGES}, {_DEG} SELECT node1, node2, a.degree + b.degree AS rank, weight FROM edges JOIN deg a ON a.node = node1 JOIN deg b ON b.node = node2 ORDER BY rank DESC, weight DESC, node1, node2 LIMIT 100")
def _(t: Tables):
    e = G.edge_ranks(X.edges(t)).select("node1", "node2", "rank", "weight")
    return top_k(e, 100, F.desc("rank"), F.desc("weight"), F.col("node1"), F.col("node2"))


@query("t5_top_degree", f"WITH {X.EDGES}, {_DEG} SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 20")
def _(t: Tables):
    return top_k(G.degrees(X.edges(t)), 20, F.desc("degree"), F.col("node"))


@query("g4_star_subgraph", f"WITH {X.EDGES}, {_DEG}, top AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 40) SELECT node1, node2 FROM edges WHERE node1 IN (FROM top) AND node2 IN (FROM top)")
def _(t: Tables):
    e = X.edges(t)
    top = top_k(G.degrees(e), 40, F.desc("degree"), F.col("node")).select("node")
    e = e.join(top.select(F.col("node").alias("node1")), "node1", "left_semi").join(top.select(F.col("node").alias("node2")), "node2", "left_semi")
    return e.select("node1", "node2")


@query("j1_ids_to_entities", f"WITH {X.ENTITIES}, ids AS (SELECT DISTINCT substr(sha256(n_name), 1, 32) AS node_id FROM nation) SELECT ent.* FROM ent JOIN ids USING (node_id)")
def _(t: Tables):
    ids = t.nation.select(sha32(F.col("n_name")).alias("node_id")).distinct()
    return X.entities(t).join(ids, "node_id").select("node_id", "node_name", "type", "sub_type", "description")


_NAMES = "names AS (SELECT n_name AS node FROM nation WHERE n_nationkey < 5)"


@query("j2_one_hop", f"WITH {X.EDGES}, {_NAMES} SELECT DISTINCT node1, node2, keywords, weight, source_id FROM edges WHERE node1 IN (FROM names) OR node2 IN (FROM names)")
def _(t: Tables):
    return G.one_hop(X.edges(t), t.nation.where("n_nationkey < 5").select(F.col("n_name").alias("node"))).select("node1", "node2", "keywords", "weight", "source_id")


@query("j3_limit_per_parent", f"WITH {X.EDGES} SELECT node1, node2 FROM (SELECT *, row_number() OVER (PARTITION BY node2 ORDER BY node1) AS rn FROM edges) WHERE rn <= 20")
def _(t: Tables):
    return G.limit_per_parent(X.edges(t), "node2", 20, "node1").select("node1", "node2")


@query("j4_endpoint_completion", f"WITH {X.EDGES}, {X.ENTITIES}, e AS (SELECT node1 AS node FROM edges UNION SELECT node2 FROM edges) SELECT node, coalesce(description, 'UNKNOWN') AS description FROM e LEFT JOIN ent ON node = node_name")
def _(t: Tables):
    ends = X.edges(t).select(F.explode(F.array("node1", "node2")).alias("node")).distinct()
    e = ends.join(X.entities(t).select(F.col("node_name").alias("node"), "description"), "node", "left")
    return e.select("node", F.coalesce("description", F.lit("UNKNOWN")).alias("description"))


@query("j7_provenance", "SELECT c_custkey, d.source FROM (SELECT c_custkey, unnest([c_custkey, c_custkey + 1]) AS ch FROM customer) JOIN documents d ON d.doc_id = ch")
def _(t: Tables):
    c = t.customer.select("c_custkey", F.explode(F.array("c_custkey", F.col("c_custkey") + 1)).alias("doc_id"))
    return c.join(t.documents.select("doc_id", "source"), "doc_id").select("c_custkey", "source")


_MAP = "m AS (SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 1 THEN (SELECT n_name FROM nation z WHERE z.n_nationkey = nation.n_nationkey - 1) END AS canonical FROM nation WHERE n_nationkey % 4 = 1)"


def _mapping(t: Tables):
    n = t.nation
    other = n.select((F.col("n_nationkey") + 1).alias("n_nationkey"), F.col("n_name").alias("canonical"))
    return n.where("n_nationkey % 4 = 1").join(other, "n_nationkey").select(F.col("n_name").alias("name"), "canonical")


@query("j8_name_mapping", f"WITH {X.EDGES}, {_MAP} SELECT coalesce(a.canonical, node1) AS node1, coalesce(b.canonical, node2) AS node2, keywords FROM edges LEFT JOIN m a ON a.name = node1 LEFT JOIN m b ON b.name = node2")
def _(t: Tables):
    return G.remap(X.edges(t), _mapping(t)).select("node1", "node2", "keywords")


@query("m35_entity_merge", f"""WITH {X.EDGES}, {_MAP}, e AS (SELECT coalesce(a.canonical, node1) AS x, coalesce(b.canonical, node2) AS y, keywords, weight, source_id FROM edges LEFT JOIN m a ON a.name = node1 LEFT JOIN m b ON b.name = node2)
  SELECT least(x, y) AS a, greatest(x, y) AS b, max(weight) AS weight, array_to_string(list_sort(list_distinct(list(keywords))), ',') AS keywords, array_to_string(list_sort(list_distinct(list(source_id))), '<SEP>') AS source_id
  FROM e WHERE x <> y GROUP BY 1, 2""")
def _(t: Tables):
    return G.merge_edges(G.remap(X.edges(t), _mapping(t)), "max")


@query("a12_edge_merge", f"""WITH {X.EDGES}, e AS (SELECT n_name AS node1, c_mktsegment AS node2, 'k' || (c_custkey % 3) || ',seg' AS keywords, 0.5::DOUBLE AS weight, 's' || (c_custkey % 4) AS source_id FROM customer JOIN nation ON c_nationkey = n_nationkey),
  k AS (SELECT node1, node2, unnest(string_split(keywords, ',')) AS w FROM e)
  SELECT least(node1, node2) AS a, greatest(node1, node2) AS b, sum(weight) AS weight, (SELECT array_to_string(list_sort(list_distinct(list(w))), ',') FROM k WHERE k.node1 = e.node1 AND k.node2 = e.node2) AS keywords,
  array_to_string(list_sort(list_distinct(list(source_id))), '<SEP>') AS source_id FROM e GROUP BY e.node1, e.node2""")
def _(t: Tables):
    e = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("node1"), F.col("c_mktsegment").alias("node2"), F.concat(F.lit("k"), F.col("c_custkey") % 3, F.lit(",seg")).alias("keywords"),
        F.lit(0.5).alias("weight"), F.concat(F.lit("s"), F.col("c_custkey") % 4).alias("source_id"),
    )
    return G.merge_edges(e)


_REC = "r AS (SELECT c_mktsegment AS name, 'type' || (c_custkey % 3) AS type, 'd' || (c_custkey % 5) AS description, 's' || (c_custkey % 4) AS source_id, c_custkey AS pos FROM customer)"


@query("a11_node_merge", f"""WITH {_REC}, k AS (SELECT name, type, count(*) AS n, min(pos) AS first FROM r GROUP BY ALL), b AS (SELECT name, arg_max(type, n * 1000000000 - first) AS type FROM k GROUP BY name)
  SELECT name, any_value(b.type) AS type, array_to_string(list_sort(list_distinct(list(description))), '<SEP>') AS description, array_to_string(list_sort(list_distinct(list(source_id))), '<SEP>') AS source_id FROM r JOIN b USING (name) GROUP BY name""")
def _(t: Tables):
    k = F.col("c_custkey")
    r = t.customer.select(F.col("c_mktsegment").alias("name"), F.concat(F.lit("type"), k % 3).alias("type"), F.concat(F.lit("d"), k % 5).alias("description"), F.concat(F.lit("s"), k % 4).alias("source_id"), k.alias("pos"))
    return G.merge_nodes(r)


@query("a13_summary_needed", f"WITH {_REC} SELECT name, count(DISTINCT description) >= 4 AS summarise FROM r GROUP BY name")
def _(t: Tables):
    g = t.customer.groupBy(F.col("c_mktsegment").alias("name")).agg(F.count_distinct(F.col("c_custkey") % 5).alias("n"))
    return g.select("name", (F.col("n") >= 4).alias("summarise"))


@query("a14_field_strategies", """SELECT c_mktsegment AS name, arg_min(c_name, c_custkey) AS first_name, arg_max(c_name, c_custkey) AS last_name, max(c_acctbal) AS best,
  array_to_string(list_sort(list_distinct(list(c_nationkey::VARCHAR))), ',') AS nations FROM customer GROUP BY 1""")
def _(t: Tables):
    return t.customer.groupBy(F.col("c_mktsegment").alias("name")).agg(
        F.min_by("c_name", "c_custkey").alias("first_name"), F.max_by("c_name", "c_custkey").alias("last_name"), F.max("c_acctbal").alias("best"),
        F.array_join(F.array_sort(F.collect_set(F.col("c_nationkey").cast("string"))), ",").alias("nations"),
    )


@query("a15_type_histogram", """WITH g AS (SELECT c_mktsegment AS type, c_nationkey AS sub, count(*) AS n FROM customer GROUP BY ALL)
  SELECT type, sub, n FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, sub) AS rn FROM g) WHERE rn <= 10""")
def _(t: Tables):
    g = t.customer.groupBy(F.col("c_mktsegment").alias("type"), F.col("c_nationkey").alias("sub")).agg(F.count("*").alias("n"))
    return G.limit_per_parent(g, "type", 10, F.desc("n"), "sub")


@query("a18_status_counts", "SELECT coalesce(o_orderstatus, 'all') AS status, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
def _(t: Tables):
    return t.orders.rollup("o_orderstatus").count().select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.col("count").alias("n"))


@query("a19_row_count", "SELECT count(*) AS n FROM lineitem")
def _(t: Tables):
    return t.lineitem.agg(F.count("*").alias("n"))


@query("a21_mentions", "SELECT user_id, event_type, count(*) AS mentions FROM events GROUP BY ALL")
def _(t: Tables):
    return t.events.groupBy("user_id", "event_type").agg(F.sum(F.lit(1)).alias("mentions"))


@query("a7_name_groups", "SELECT trim(p_name) AS name, count(*) AS n, list_sort(list(p_partkey)) AS ids FROM part WHERE trim(p_name) <> '' GROUP BY 1")
def _(t: Tables):
    return D.name_groups(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("a8_relation_groups", """SELECT n_name AS node1, c_mktsegment AS node2, 'lives' AS relation, 'h' AS type, count(*) AS n, array_to_string(list_sort(list_distinct(list((c_custkey % 6)::VARCHAR))), ',') AS chunk_ids
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def _(t: Tables):
    r = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("node1"), F.col("c_mktsegment").alias("node2"), F.lit("lives").alias("relation"), F.lit("h").alias("type"), F.array((F.col("c_custkey") % 6).cast("string")).alias("chunk_ids")
    )
    return D.relation_groups(r)


@query("a9_merge_group", """WITH g AS (SELECT p_brand, (SELECT p_type FROM part z WHERE z.p_brand = part.p_brand ORDER BY length(p_type) DESC, p_type DESC LIMIT 1) AS description, p_size FROM part)
  SELECT p_brand, description, list_sort(list_distinct(list(p_size))) AS chunk_ids, substr(sha256(description), 1, 32) AS id FROM g GROUP BY p_brand, description""")
def _(t: Tables):
    return D.merge_group(t.part.select("p_brand", F.col("p_type").alias("description"), F.array("p_size").alias("chunk_ids")), "p_brand")


_ALIAS = "al AS (SELECT 'u' || (user_id % 60) AS a, 'u' || ((user_id % 60) // 4) AS b FROM events)"
_CC = """RECURSIVE {al}, nb AS (SELECT a AS x, b AS y FROM al WHERE a <> b UNION SELECT b, a FROM al WHERE a <> b),
  reach(x, y) AS (SELECT x, x FROM nb UNION SELECT reach.x, nb.y FROM reach JOIN nb ON nb.x = reach.y),
  comp AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x)"""


def _alias(t: Tables):
    u = (F.col("user_id") % 60).cast("long")
    return t.events.select(F.concat(F.lit("u"), u).alias("a"), F.concat(F.lit("u"), F.floor(u / 4)).alias("b"))


@query("a25_alias_components", f"""WITH {_CC.format(al=_ALIAS)} SELECT id AS name, (SELECT z.id FROM comp z WHERE z.component = comp.component ORDER BY length(z.id) DESC, z.id LIMIT 1) AS canonical FROM comp""")
def _(t: Tables):
    return G.alias_groups(_alias(t))


@query("a26_overlap_groups", """WITH RECURSIVE s AS (SELECT DISTINCT doc_id % 90 AS set_id, substr(md5(text), 1, 2) AS member FROM documents WHERE text IS NOT NULL),
  nb AS (SELECT DISTINCT a.set_id AS x, b.set_id AS y FROM s a JOIN s b USING (member)), reach(x, y) AS (SELECT x, x FROM nb UNION SELECT reach.x, nb.y FROM reach JOIN nb ON nb.x = reach.y)
  SELECT x AS set_id, min(y) AS "group" FROM reach GROUP BY x""")
def _(t: Tables):
    s = t.documents.where("text IS NOT NULL").select((F.col("doc_id") % 90).alias("set_id"), F.substring(F.md5("text"), 1, 2).alias("member")).distinct()
    return G.overlap_groups(s)


@query("a25_alias_components_whole")
def _(t: Tables):
    u = F.col("user_id").cast("long")
    return G.alias_groups(t.events.select(F.concat(F.lit("u"), u).alias("a"), F.concat(F.lit("u"), F.floor(u / 4)).alias("b")))


@query("a26_overlap_groups_whole")
def _(t: Tables):
    s = t.documents.select(F.col("doc_id").alias("set_id"), F.explode(split_markers(F.col("text"), [". "])).alias("member")).distinct()
    return G.overlap_groups(s.select("set_id", F.sha2("member", 256).alias("member")))


@query("a27_agglomerative")
def _(t: Tables):
    """By connected parts of near vectors: a whole label's matrix would grow with its square in one task."""
    return D.agglomerate_parts(t.embeddings.where("label IS NOT NULL"), "label")


@query("a28_mapping_union", "SELECT key, array_to_string(list(value ORDER BY pos), ',') AS \"values\" FROM (SELECT user_id AS key, event_type AS value, min(event_id) AS pos FROM events GROUP BY ALL) GROUP BY key")
def _(t: Tables):
    return D.merge_mappings(t.events.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("pos")))


_COS = "(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))"


@query("j10_similarity_self_join", f"""SELECT a, b, score FROM (SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS rn
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE round({_COS}, 6) >= 0.2) WHERE rn <= 5""")
def _(t: Tables):
    return D.similar_pairs(t.embeddings, "label", 0.2, 5)


@query("j11_theta_cosine", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round({_COS}, 6) >= 0.3")
def _(t: Tables):
    return D.similar_pairs(t.embeddings, "label", 0.3)


@query("c8_mutual_merge")
def _(t: Tables):
    return D.mutual_best_vectors(t.embeddings, "label", 0.3)


@query("j12_pattern_both_ways", f"WITH {X.EDGES} SELECT DISTINCT n, m FROM (SELECT node1 AS n, node2 AS m FROM edges UNION SELECT node2, node1 FROM edges) WHERE n LIKE 'NATION%' OR n IN (SELECT n_name FROM nation)")
def _(t: Tables):
    e = X.edges(t)
    both = e.select(F.col("node1").alias("n"), F.col("node2").alias("m")).union(e.select("node2", "node1")).distinct()
    return both.join(t.nation.select(F.col("n_name").alias("n")), "n", "left_semi").select("n", "m")


@query("j13_node_batch", f"WITH {X.EDGES}, {_DEG}, i AS (SELECT unnest(range(0, 30)) AS pos) SELECT pos, 'x' AS kind, coalesce(degree, 0) AS degree FROM i LEFT JOIN nation ON n_nationkey = pos LEFT JOIN deg ON node = n_name")
def _(t: Tables):
    ids = t.spark.range(30).select(F.col("id").alias("pos"), F.col("id").cast("int").alias("n_nationkey"))
    d = ids.join(t.nation, "n_nationkey", "left").join(G.degrees(X.edges(t)).withColumnRenamed("node", "n_name"), "n_name", "left")
    return d.select("pos", F.lit("x").alias("kind"), F.coalesce("degree", F.lit(0)).alias("degree"))


@query("j14_array_overlap", "SELECT doc_id FROM documents WHERE list_has_any(string_split(text, ' '), ['idiot', 'scum', 'clown'])")
def _(t: Tables):
    return t.documents.where(F.arrays_overlap(F.split("text", " "), F.array(*[F.lit(w) for w in ("idiot", "scum", "clown")]))).select("doc_id")


@query("j15_multi_value_semi", "SELECT c_mktsegment AS name, string_agg('s' || k, '<SEP>' ORDER BY k) AS source_id FROM (SELECT DISTINCT c_mktsegment, c_custkey % 4 AS k FROM customer) GROUP BY 1 HAVING list_has_any(list('s' || k), ['s1', 's9'])")
def _(t: Tables):
    g = t.customer.groupBy(F.col("c_mktsegment").alias("name")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("s"), F.col("c_custkey") % 4))), "<SEP>").alias("source_id"))
    return g.where(F.arrays_overlap(F.split("source_id", "<SEP>"), F.array(F.lit("s1"), F.lit("s9"))))


@query("g1_one_hop_ranked", f"WITH {X.EDGES}, {_DEG}, {_NAMES} SELECT node1, node2, a.degree + b.degree AS rank, weight FROM edges JOIN deg a ON a.node = node1 JOIN deg b ON b.node = node2 WHERE node1 IN (FROM names) OR node2 IN (FROM names)")
def _(t: Tables):
    names = t.nation.where("n_nationkey < 5").select(F.col("n_name").alias("node"))
    return G.one_hop(G.edge_ranks(X.edges(t)), names).select("node1", "node2", "rank", "weight")


@query("g2_endpoints", f"""WITH e AS (SELECT c_custkey AS pos, c_mktsegment AS node1, n_name AS node2 FROM customer JOIN nation ON c_nationkey = n_nationkey),
  u AS (SELECT pos * 2 AS p, node1 AS node FROM e UNION ALL SELECT pos * 2 + 1, node2 FROM e) SELECT node, row_number() OVER (ORDER BY min(p)) AS pos FROM u GROUP BY node""")
def _(t: Tables):
    e = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("node1"), F.col("n_name").alias("node2"))
    return G.endpoints(e)


@query("g3_bfs_subgraph", f"""WITH RECURSIVE {X.EDGES}, {_DEG}, nb AS (SELECT node1 AS a, node2 AS b FROM edges UNION SELECT node2, node1 FROM edges),
  walk(node, depth) AS (SELECT n_name, 0 FROM nation WHERE n_nationkey = 0 UNION SELECT b, depth + 1 FROM walk JOIN nb ON a = node WHERE depth < 3),
  s AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node) SELECT node, depth FROM s JOIN deg USING (node) ORDER BY depth, degree DESC, node LIMIT 200""")
def _(t: Tables):
    start = t.nation.where("n_nationkey = 0").select(F.col("n_name").alias("node"))
    return G.subgraph(X.edges(t), start, 3, 200)[0]


@query("g5_rename_entity", f"WITH {X.EDGES} SELECT CASE WHEN node1 = 'ASIA' THEN 'Asia' ELSE node1 END AS node1, CASE WHEN node2 = 'ASIA' THEN 'Asia' ELSE node2 END AS node2 FROM edges")
def _(t: Tables):
    return G.remap(X.edges(t), t.spark.createDataFrame([("ASIA", "Asia")], "name string, canonical string")).select("node1", "node2")


@query("g6_delete_document", """WITH k AS (SELECT c_mktsegment AS name, list_distinct(list(c_custkey % 5)) AS src FROM customer GROUP BY 1 UNION ALL SELECT 'n' || n_nationkey, [n_nationkey % 5] FROM nation)
  SELECT name, CASE WHEN len(list_filter(src, lambda x: x <> 1)) = 0 THEN 'delete' WHEN len(list_filter(src, lambda x: x <> 1)) < len(src) THEN 'rebuild' ELSE 'keep' END AS action FROM k""")
def _(t: Tables):
    k = t.customer.groupBy(F.col("c_mktsegment").alias("name")).agg(F.collect_set((F.col("c_custkey") % 5).cast("int")).alias("src"))
    k = k.unionByName(t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.array((F.col("n_nationkey") % 5).cast("int")).alias("src")))
    left = F.array_except("src", F.array(F.lit(1)))
    return k.select("name", F.when(F.size(left) == 0, "delete").when(F.size(left) < F.size("src"), "rebuild").otherwise("keep").alias("action"))


@query("g7_labels", f"WITH {X.EDGES} SELECT DISTINCT node1 AS label FROM edges ORDER BY 1")
def _(t: Tables):
    return X.edges(t).select(F.col("node1").alias("label")).distinct().orderBy("label")


@query("g8_overview", f"WITH {X.EDGES}, {_DEG} SELECT node, degree, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM deg) AS n_nodes FROM deg ORDER BY degree DESC, node LIMIT 5")
def _(t: Tables):
    e = X.edges(t)
    d = G.degrees(e)
    top = top_k(d, 5, F.desc("degree"), F.col("node"))
    return top.crossJoin(F.broadcast(e.agg(F.count("*").alias("n_edges")))).crossJoin(F.broadcast(d.agg(F.count("*").alias("n_nodes"))))


@query("p14_unprocessed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t: Tables):
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("p19_hierarchy_edges", f"WITH {X.EDGES} SELECT DISTINCT node1, node2 FROM edges WHERE keywords IN ('part of', 'supplies')")
def _(t: Tables):
    return X.edges(t).where(F.col("keywords").isin("part of", "supplies")).select("node1", "node2").distinct()


@query("s20_missing_keys", "SELECT i AS id FROM (SELECT unnest(range(0, 3000, 11)) AS i) WHERE i NOT IN (SELECT doc_id FROM documents)")
def _(t: Tables):
    return t.spark.range(0, 3000, 11).join(t.documents.select(F.col("doc_id").alias("id")), "id", "left_anti")


@query("s19_vectors_by_ids", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def _(t: Tables):
    return t.embeddings.join(t.labels.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id", "label")


@query("u1_union_all", "SELECT doc_id AS id, 'd' AS src FROM documents UNION ALL SELECT item_id, 'b' FROM benchmark")
def _(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), F.lit("d").alias("src")).unionByName(t.benchmark.select(F.col("item_id").alias("id"), F.lit("b").alias("src")))


@query("u2_union_first", """WITH u AS (SELECT doc_id % 200 AS id, 0 AS list, doc_id AS pos FROM documents UNION ALL SELECT item_id, 1, item_id FROM benchmark)
  SELECT id, list, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY list, pos) AS rn FROM u) WHERE rn = 1""")
def _(t: Tables):
    u = t.documents.select((F.col("doc_id") % 200).alias("id"), F.lit(0).alias("list"), F.col("doc_id").alias("pos"))
    return first_occurrence(u.unionByName(t.benchmark.select(F.col("item_id").alias("id"), F.lit(1).alias("list"), F.col("item_id").alias("pos"))), "id", "list", "pos")


@query("u3_difference", "SELECT vec_id AS id FROM embeddings EXCEPT SELECT doc_id FROM labels")
def _(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id")).exceptAll(t.labels.select("doc_id")).distinct()


@query("u5_pair_dedup", f"WITH {X.EDGES} SELECT DISTINCT node2, keywords FROM edges")
def _(t: Tables):
    return X.edges(t).select("node2", "keywords").dropDuplicates(["node2", "keywords"])


@query("u6_content_dedup", "SELECT min(doc_id) AS doc_id, md5(trim(regexp_replace(trim(text, ' '), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), ' ')) AS hash FROM documents GROUP BY 2")
def _(t: Tables):
    return D.content_dedup(t.documents)


@query("u7_intersect", "SELECT vec_id AS id FROM embeddings INTERSECT SELECT doc_id FROM labels")
def _(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id")).intersect(t.labels.select("doc_id"))


@query("j19_wiki_links", r"""WITH l AS (SELECT DISTINCT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS href FROM pages)
  SELECT DISTINCT l.page_id, p.page_id AS target FROM l JOIN pages p ON p.url = href WHERE p.page_id <> l.page_id""")
def _(t: Tables):
    l = t.pages.select("page_id", F.explode(hrefs(F.col("html"))).alias("url"))
    return l.join(t.pages.select(F.col("page_id").alias("target"), "url"), "url").where("page_id <> target").select("page_id", "target").distinct()


@query("sanitized_lengths", "SELECT doc_id, length(trim(text, ' ')) AS n FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.length(sanitize(F.col("text"))).alias("n"))


@query("m27_cache_lookup", "SELECT user_id, list(event_type ORDER BY ts, event_id) AS kinds FROM events GROUP BY user_id")
def _(t: Tables):
    g = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("k"))
    return g.select("user_id", F.transform("k", lambda x: x["event_type"]).alias("kinds"))


@query("m27_cache_lookup_whole", "SELECT user_id, list(event_type ORDER BY ts, event_id) AS kinds FROM events GROUP BY user_id")
def _(t: Tables):
    g = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("k"))
    return g.select("user_id", F.transform("k", lambda x: x["event_type"]).alias("kinds"))


@query("m28_path_budget", "WITH RECURSIVE d AS (SELECT DISTINCT lang, source FROM documents), o AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY source) AS rn FROM d), w(lang, rn, used, paths) AS (SELECT lang, 0::BIGINT, 0::BIGINT, []::VARCHAR[] FROM (SELECT DISTINCT lang FROM d) UNION ALL SELECT w.lang, o.rn, CASE WHEN used + strlen(source) <= 30 THEN used + strlen(source) ELSE used END, CASE WHEN used + strlen(source) <= 30 THEN list_append(paths, source) ELSE paths END FROM w JOIN o ON o.lang = w.lang AND o.rn = w.rn + 1) SELECT lang, array_to_string(arg_max(paths, rn), '<SEP>') AS paths FROM w GROUP BY lang")
def _(t: Tables):
    g = t.documents.groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("s"))
    kept = F.aggregate(
        "s", F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("paths")),
        lambda a, x: F.when(a["used"] + F.octet_length(x) <= 30, F.struct((a["used"] + F.octet_length(x)).alias("used"), F.array_append(a["paths"], x).alias("paths"))).otherwise(a),
        lambda a: F.array_join(a["paths"], "<SEP>"),
    )
    return g.select("lang", kept.alias("paths"))


@query("w3_citations_per_region", f"WITH {X.ENTITIES}, {X.BRIDGE} SELECT sub_type, count(*) AS n, count(DISTINCT chunk_id) AS chunks FROM bridge JOIN ent ON cluster_id = node_id GROUP BY 1")
def _(t: Tables):
    b = X.bridge(t).join(X.entities(t), F.col("cluster_id") == F.col("node_id"))
    return b.groupBy("sub_type").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("chunks"))

