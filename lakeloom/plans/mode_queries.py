"""Queries of retrieval modes, upkeep, trees, records and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import records as rec
from lakeloom.functions.text import slugify, terms
from lakeloom.functions.vectors import cosine, inner_product
from lakeloom.operators import dedup as D
from lakeloom.operators import graph as G
from lakeloom.operators import modes as M
from lakeloom.operators import retrieval as R
from lakeloom.operators import tables as T
from lakeloom.operators import upkeep as U
from lakeloom.plans import fixtures as X
from lakeloom.plans.registry import Tables, query
from lakeloom.session import materialize
from lakeloom.sources import readers, writers

_V = "{0}.embedding::DOUBLE[]"
_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_COS = f"({_DOT} / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))"
#: For each vector whose id is divisible by 100 the others of its label, by cosine.
_NEAR = f"""near AS (SELECT a.vec_id AS qid, b.vec_id AS id, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"""


def _queries(t: Tables):
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), "label")


def _near(t: Tables, k: int):
    """(qid, id, score, rank): the k nearest others of each query's label."""
    hits = R.vector_top_k_batch(t.embeddings, _queries(t), k + 1, "label").where("qid <> vec_id")
    return R.limit_ranks(hits.withColumnRenamed("vec_id", "id"), k)


@query("r3_query_variants", f"""WITH h AS (SELECT b.vec_id AS variant, a.vec_id AS id, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({_DOT}, 6) DESC, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id < 5),
  k AS (SELECT * FROM h WHERE rank <= 8 AND variant <= 3) SELECT id, min(variant) AS variant, arg_min(rank, variant * 1000 + rank) AS rank FROM k GROUP BY id""")
def _(t: Tables):
    hits = None
    for v in range(5):  # the query and four rewritings, of which three count
        one = R.vector_top_k(t.embeddings, X.query_vector(t, v), 8).withColumn("rank", F.row_number().over(R.W.orderBy(F.desc("score"), "vec_id")))
        one = one.select(F.lit(v).cast("long").alias("variant"), "rank", F.col("vec_id").alias("id"))
        hits = one if hits is None else hits.unionByName(one)
    return M.variant_union(hits)


@query("r4_multihop", f"""WITH RECURSIVE e AS (SELECT vec_id, label FROM embeddings), s AS (SELECT b.vec_id AS id FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY round({_DOT}, 6) DESC, b.vec_id LIMIT 3),
  h0 AS (SELECT id, 0 AS hop FROM s), h1 AS (SELECT o_custkey AS id, 1 AS hop FROM orders WHERE o_orderkey IN (SELECT id FROM h0)),
  h2 AS (SELECT o_orderkey AS id, 2 AS hop FROM orders WHERE o_custkey IN (SELECT id FROM h1 WHERE id NOT IN (SELECT id FROM h0)))
  SELECT id, min(hop) AS hop FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY id""")
def _(t: Tables):
    start = R.vector_top_k(t.embeddings, X.query_vector(t), 3).select(F.col("vec_id").alias("id"))
    o, turn = t.orders, [0]

    def hop(ids):
        turn[0] += 1
        have, want = ("o_orderkey", "o_custkey") if turn[0] % 2 else ("o_custkey", "o_orderkey")
        return o.join(ids.withColumnRenamed("id", have), have, "left_semi").select(F.col(want).alias("id"))

    return M.multi_hop(start, hop, 2)


_LOCAL = f"""deg AS (SELECT node, count(*) AS degree FROM (SELECT node1 AS node FROM edges UNION ALL SELECT node2 FROM edges) GROUP BY node),
  loc AS (SELECT qid, n_name AS node, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM near JOIN nation ON n_nationkey = id % 25 WHERE near.rank <= 6),
  glo AS (SELECT node, row_number() OVER (ORDER BY degree DESC, node) AS rank FROM deg QUALIFY rank <= 6)"""


@query("r9_memory_mix", f"""WITH {X.EDGES}, {_NEAR}, {_LOCAL}, l AS (SELECT qid, 0 AS list_no, rank, node FROM loc UNION ALL SELECT qid, 1, glo.rank, node FROM (SELECT DISTINCT qid FROM loc), glo),
  f AS (SELECT qid, node, min(rank * 10 + list_no) AS place FROM l GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place, node) AS pos FROM f)
  SELECT qid, node, pos FROM (SELECT *, sum(length(node)) OVER (PARTITION BY qid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM p) WHERE used <= 60""")
def _(t: Tables):
    """Local entities (nearest to each query) and global ones (of high degree) by turns, within a token budget."""
    near = _near(t, 6).join(t.nation, F.col("n_nationkey") == F.col("id") % 25)
    local = near.select("qid", F.lit(0).alias("list_no"), F.row_number().over(R.W.partitionBy("qid").orderBy("rank")).alias("rank"), F.col("n_name").alias("id"))
    top = R.top_k(G.degrees(X.edges(t)), 6, F.desc("degree"), F.col("node")).withColumn("rank", F.row_number().over(R.W.orderBy(F.desc("degree"), "node")))
    wide = local.select("qid").distinct().crossJoin(F.broadcast(top))  # six rows
    mixed = M.interleaved(local.unionByName(wide.select("qid", F.lit(1).alias("list_no"), "rank", F.col("node").alias("id"))))
    return R.token_budget(mixed.withColumn("tokens", F.length("id")), 60, group=["qid"]).select("qid", F.col("id").alias("node"), "pos")


@query("r10_chunk_pick", f"""WITH c AS (SELECT vec_id AS chunk_id FROM embeddings WHERE label IN (0, 1, 2)), s AS (SELECT a.vec_id AS chunk_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0)
  SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS pos FROM c JOIN s USING (chunk_id) QUALIFY pos <= 7""")
def _(t: Tables):
    e = t.embeddings.where("label IN (0, 1, 2)")
    chunks = e.select(F.col("label").cast("long").alias("grp"), F.row_number().over(R.W.partitionBy("label").orderBy("vec_id")).alias("rn"), F.col("vec_id").alias("chunk_id"))
    scores = t.embeddings.crossJoin(F.broadcast(X.query_vector(t))).select(F.col("vec_id").alias("chunk_id"), F.round(cosine("embedding", "q"), 6).alias("score"))
    return M.pick_chunks(chunks, scores, 3)


@query("r11_mode_fallback", """WITH k AS (SELECT conv_id, max(CASE WHEN role = 'user' THEN text END) AS low, max(CASE WHEN role = 'system' THEN text END) AS high FROM conversations GROUP BY conv_id),
  m AS (SELECT conv_id, trim(coalesce(low, ''), ' ') <> '' AS l, trim(coalesce(high, ''), ' ') <> '' AS h FROM k) SELECT conv_id, CASE WHEN l AND h THEN 'hybrid' WHEN l THEN 'local' WHEN h THEN 'global' ELSE 'fail' END AS mode FROM m""")
def _(t: Tables):
    k = t.conversations.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("low"), F.max(F.when(F.col("role") == "system", F.col("text"))).alias("high"))
    return k.select("conv_id", M.mode_for(F.col("low"), F.col("high")).alias("mode"))


@query("r16_table_pipeline", """WITH n AS (SELECT n_name AS entity FROM nation), p AS (SELECT unnest(['1995', '1996', '1997']) AS time),
  a AS (SELECT n_name AS entity, year(o_orderdate)::VARCHAR AS time, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
  SELECT n.entity, p.time, orders::DECIMAL(28,6) AS orders, revenue::DECIMAL(28,6) AS revenue FROM n CROSS JOIN p LEFT JOIN a ON a.entity = n.entity AND a.time = p.time""")
def _(t: Tables):
    """Schema, task grid, answers, pivot and typed load in one plan."""
    o = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    a = o.groupBy(F.col("n_name").alias("entity"), F.year("o_orderdate").cast("string").alias("time")).agg(F.count("*").cast("string").alias("orders"), F.round(F.sum("o_totalprice"), 2).cast("decimal(28,6)").cast("string").alias("revenue"))
    answers = a.unpivot(["entity", "time"], ["orders", "revenue"], "metric", "answer")
    spark = t.spark
    periods = spark.createDataFrame([(i, y) for i, y in enumerate(("1995", "1996", "1997"))], "pos long, time string")
    metrics = spark.createDataFrame([(0, "orders"), (1, "revenue")], "pos long, metric string")
    grid = T.task_grid(t.nation.select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("entity")), periods, metrics)
    return T.typed_table(T.pivot_answers(T.fill_answers(grid, answers), ["orders", "revenue"]), ["orders", "revenue"])


@query("r17_caption_memory", f"""WITH {_NEAR},
  o AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM near WHERE id % 100 <> 0)
  SELECT vec_id AS id, CASE WHEN score >= 0.98 THEN 'remain' WHEN score >= 0.8 THEN 'update' ELSE 'add' END AS event, CASE WHEN score >= 0.8 THEN o.id END AS match FROM embeddings LEFT JOIN o ON qid = vec_id AND r = 1 WHERE vec_id % 100 = 0""")
def _(t: Tables):
    new = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return U.caption_decisions(new, t.embeddings.where("vec_id % 100 <> 0").select(F.col("vec_id").alias("match"), F.col("embedding").alias("w"), "label"), "label")


@query("r19_cascade", f"""WITH {_NEAR}, f AS (SELECT qid, 0 AS n, 'facts' AS stage, id::VARCHAR AS answer FROM near WHERE rank = 1 AND score >= 0.98),
  g AS (SELECT qid, 1, 'graph', id::VARCHAR FROM near WHERE rank = 1 AND score >= 0.9), k AS (SELECT vec_id, 2, 'knowledge base', source FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0)
  SELECT qid, arg_min(stage, n) AS stage, arg_min(answer, n) AS answer FROM (FROM f UNION ALL FROM g UNION ALL FROM k) GROUP BY qid""")
def _(t: Tables):
    near = _near(t, 1).select("qid", F.col("id").alias("answer"), "score")
    kb = t.documents.where("doc_id % 100 = 0").join(_queries(t).select(F.col("qid").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("qid"), F.col("source").alias("answer"))
    return M.cascade(("facts", near, F.col("score") >= 0.98), ("graph", near, F.col("score") >= 0.9), ("knowledge base", kb, F.lit(True)))


@query("m37_parametric_or_graph", f"""WITH {_NEAR} SELECT qid, CASE WHEN quality = 1 THEN 'parametric' ELSE 'graph' END AS stage, CASE WHEN quality = 1 THEN 'known' ELSE id::VARCHAR END AS answer FROM near LEFT JOIN labels ON doc_id = qid WHERE rank = 1""")
def _(t: Tables):
    near = _near(t, 1).select("qid", F.col("id").alias("answer"))
    known = near.join(t.labels.select(F.col("doc_id").alias("qid"), "quality"), "qid").select("qid", F.lit("known").alias("answer"), "quality")
    return M.cascade(("parametric", known, F.col("quality") == 1), ("graph", near, F.lit(True)))


@query("t2_candidate_caps", f"WITH {_NEAR} SELECT qid, id, rank FROM near WHERE rank <= least(3 * 5, 50)")
def _(t: Tables):
    return _near(t, M.candidates(5)).select("qid", "id", "rank")


_RERANK = f"h AS (SELECT qid, near.id, rank, round(near.score * 0.5 + (near.id % 7), 6) AS s FROM {{0}} near WHERE rank <= 15)"


def _model():
    """Stands for a reranker: any column expression can."""
    return F.round(F.col("score") * 0.5 + F.col("id") % 7, 6)


@query("t7_rerank", f"WITH {_NEAR}, {_RERANK.format('near AS')} SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rank) AS pos FROM h QUALIFY pos <= 5")
def _(t: Tables):
    return M.rerank(_near(t, 15), _model(), 5).select("qid", "id", "pos")


@query("t8_rerank_fallback", f"WITH {_NEAR} SELECT qid, id, rank AS pos FROM near WHERE rank <= 5")
def _(t: Tables):
    return M.rerank(_near(t, 15), None, 5).select("qid", "id", "pos")


@query("t9_context_chunks", f"""WITH {_NEAR}, {_RERANK.format('near AS')}, k AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rank) AS pos FROM h WHERE s >= 2 QUALIFY pos <= 6),
  b AS (SELECT qid, id, pos, sum(n_chars) OVER (PARTITION BY qid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM k JOIN documents ON doc_id = id) SELECT qid, id, pos FROM b WHERE used <= 6000""")
def _(t: Tables):
    hits = M.rerank(_near(t, 15), _model(), 6, 2.0).join(t.documents.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("tokens")), "id")
    return R.token_budget(hits, 6000, group=["qid"]).select("qid", "id", "pos")


@query("t12_path_order", "SELECT DISTINCT url, lower(url) AS sort_key FROM pages ORDER BY lower(url), url LIMIT 50")
def _(t: Tables):
    return R.top_k(t.pages.select("url", F.lower("url").alias("sort_key")).distinct(), 50, F.col("sort_key"), F.col("url"))


@query("t13_newest_first", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(t: Tables):
    return U.newest(t.events.select("event_id", "ts"), "ts", "event_id", "2 DAYS", 100)


@query("u4_disjoint", "SELECT conv_id, NOT list_has_any(list(DISTINCT role), ['system']) AS disjoint FROM conversations WHERE role IS NOT NULL GROUP BY conv_id")
def _(t: Tables):
    roles = t.conversations.where("role IS NOT NULL").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return roles.select("conv_id", (~F.arrays_overlap("roles", F.array(F.lit("system")))).alias("disjoint"))


@query("f21_citation_block", "SELECT conv_id, string_agg('[' || turn || '] ' || text, chr(10) || chr(10) ORDER BY turn) AS block FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def _(t: Tables):
    g = t.conversations.where("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("n"), "text"))).alias("x"))
    return g.select("conv_id", rec.citation_block(F.col("x")).alias("block"))


def _replies(t: Tables):
    """A model's reply about each part, as delimited tuples with noise around them; what a reply holds differs from part to part."""
    p = t.part
    entity = F.concat(F.lit('("entity"<|>"'), "p_name", F.lit('"<|>"'), "p_brand", F.lit('"<|>"'), "p_type", F.lit(' of size '), F.col("p_size").cast("string"), F.lit('")'))
    relation = F.concat(F.lit('("relationship"<|>"'), "p_name", F.lit('"<|>"'), "p_brand", F.lit('"<|>"made by"<|>"brand"<|>'), F.col("p_size").cast("string"), F.lit(")"))
    k = F.col("p_partkey")
    parts = [F.when(k % 2 == 0, F.lit("noise")), F.when(k % 3 > 0, entity), F.when(k % 5 == 0, F.lit("(bad)")), F.when(k % 4 > 0, relation), F.lit("<|COMPLETE|>")]
    return p.select("p_partkey", F.concat_ws("##", *parts).alias("reply"))


@query("f22_tuple_records", """SELECT p_partkey, (p_partkey % 3 > 0)::INT + (p_partkey % 5 = 0)::INT + (p_partkey % 4 > 0)::INT AS n_records,
  list_concat(CASE WHEN p_partkey % 3 > 0 THEN [4] ELSE [] END, list_concat(CASE WHEN p_partkey % 5 = 0 THEN [1] ELSE [] END, CASE WHEN p_partkey % 4 > 0 THEN [6] ELSE [] END)) AS n_fields FROM part""")
def _(t: Tables):
    r = _replies(t).withColumn("r", rec.tuple_records(F.col("reply")))
    return r.select("p_partkey", F.size("r").alias("n_records"), F.transform("r", lambda x: F.size(x)).alias("n_fields"))


@query("p12_entity_tuples", "SELECT p_name AS name, lower(p_brand) AS type, p_type || ' of size ' || p_size AS description FROM part WHERE p_partkey % 3 > 0")
def _(t: Tables):
    return _replies(t).select(F.inline(rec.entity_records(F.col("reply"))))


@query("p13_relation_tuples", "SELECT p_name AS source, p_brand AS target, 'brand' AS keywords, 'made by' AS description, p_size::DOUBLE AS weight FROM part WHERE p_partkey % 4 > 0")
def _(t: Tables):
    return _replies(t).select(F.inline(rec.relation_records(F.col("reply"))))


@query("f42_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def _(t: Tables):
    return t.events.select("event_id", rec.iso_time(F.col("ts")).alias("at"))


def _tree(t: Tables):
    """World, regions, nations as nodes(id, parent, name)."""
    r = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("w").alias("parent"), F.col("r_name").alias("name"))
    n = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    return r.unionByName(n).unionByName(t.spark.range(1).select(F.lit("w").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("World").alias("name")))


@query("f45_tree_flatten", "SELECT 'w' AS id, 0 AS depth, ['World'] AS path UNION ALL SELECT 'r' || r_regionkey, 1, ['World', r_name] FROM region UNION ALL SELECT 'n' || n_nationkey, 2, ['World', r_name, n_name] FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(t: Tables):
    return U.flatten_tree(_tree(t))


@query("f45_tree_assemble", """SELECT 'World' AS path, (SELECT list(r_name ORDER BY r_name) FROM region) AS children UNION ALL SELECT 'World/' || r_name, list(n_name ORDER BY n_name) FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name
  UNION ALL SELECT 'World/' || r_name || '/' || n_name, [] FROM nation JOIN region ON r_regionkey = n_regionkey""")
def _(t: Tables):
    return U.assemble_tree(U.flatten_tree(_tree(t))).select(F.array_join("path", "/").alias("path"), "children")


@query("m23_tree_enrichment", f"WITH {_NEAR} SELECT r_name, coalesce(list(id ORDER BY rank) FILTER (id IS NOT NULL), []) AS context FROM region LEFT JOIN near ON qid = r_regionkey * 100 AND rank <= 5 GROUP BY r_name")
def _(t: Tables):
    near = _near(t, 5).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("c"))
    r = t.region.join(near, F.col("qid") == F.col("r_regionkey") * 100, "left")
    return r.select("r_name", F.coalesce(F.transform("c", lambda x: x["id"]), F.array().cast("array<long>")).alias("context"))


@query("m24_node_info", "SELECT 'World/' || r_name AS path, r_regionkey * 2 AS info FROM region UNION ALL SELECT 'World/' || r_name || '/' || n_name, NULL FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'World', NULL")
def _(t: Tables):
    info = t.region.select(F.array(F.lit("World"), "r_name").alias("path"), (F.col("r_regionkey") * 2).alias("info"))
    return U.flatten_tree(_tree(t)).join(info, "path", "left").select(F.array_join("path", "/").alias("path"), "info")


_G9 = f"""{_NEAR}, o AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM near WHERE id % 100 <> 0), m AS (SELECT qid AS name, id AS canonical FROM o WHERE r = 1 AND score >= 0.9),
  new AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings WHERE vec_id % 100 = 0), mapped AS (SELECT coalesce(x.canonical, a)::VARCHAR AS node1, coalesce(y.canonical, b)::VARCHAR AS node2 FROM new LEFT JOIN m x ON x.name = a LEFT JOIN m y ON y.name = b)"""


def _graph_insert(t: Tables):
    e = t.embeddings
    new = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    stored = e.where("vec_id % 100 <> 0").select(F.col("vec_id").alias("match"), F.col("embedding").alias("w"), "label")
    found = U.best_matches(new, stored, 0.9, "label").select(F.col("id").cast("string").alias("id"), F.col("match").cast("string").alias("match"))
    nodes = stored.select(F.col("match").cast("string").alias("node"), F.lit(1).cast("long").alias("mentions"))
    relations = new.select(F.col("id").cast("string").alias("node1"), F.lit("next").alias("relation"), (F.col("id") + 1).cast("string").alias("node2"))
    edges = relations.where("node1 = '0'").withColumn("mentions", F.lit(4).cast("long"))
    return U.insert_relations(nodes, edges, relations, found)


@query("g9_graph_insert_nodes", f"WITH {_G9}, met AS (SELECT node, count(*) AS more FROM (SELECT node1 AS node FROM mapped UNION ALL SELECT node2 FROM mapped) GROUP BY node), old AS (SELECT vec_id::VARCHAR AS node FROM embeddings WHERE vec_id % 100 <> 0) SELECT coalesce(old.node, met.node) AS node, (old.node IS NOT NULL)::BIGINT + coalesce(more, 0) AS mentions FROM old FULL JOIN met ON old.node = met.node")
def _(t: Tables):
    return _graph_insert(t)[0]


@query("g9_graph_insert_edges", f"WITH {_G9}, a AS (SELECT node1, node2, count(*) AS more FROM mapped GROUP BY ALL), had AS (SELECT '0' AS node1, '1' AS node2, 4 AS mentions) SELECT coalesce(had.node1, a.node1) AS node1, 'next' AS relation, coalesce(had.node2, a.node2) AS node2, (coalesce(mentions, 0) + coalesce(more, 0))::BIGINT AS mentions FROM had FULL JOIN a ON had.node1 = a.node1 AND had.node2 = a.node2")
def _(t: Tables):
    return _graph_insert(t)[1]


@query("g9_delete_relation", "SELECT n_name AS node1, 'part of' AS relation, r_name AS node2 FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA'")
def _(t: Tables):
    e = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node1"), F.lit("part of").alias("relation"), F.col("r_name").alias("node2"))
    return U.delete_relations(e, e.where("node2 = 'ASIA'"))


def _records(t: Tables):
    """What documents say of nations: records(name, type, description, source_id, pos)."""
    d = t.documents.where("doc_id IS NOT NULL").select("doc_id", "lang", "source", (F.col("doc_id") % 20).cast("int").alias("n_nationkey"))
    return d.join(t.nation, "n_nationkey").select(F.col("n_name").alias("name"), F.coalesce("lang", F.lit("?")).alias("type"), F.coalesce("source", F.lit("?")).alias("description"), F.lit("d").alias("source_id"), F.col("doc_id").alias("pos"))


_RECORDS = "rec AS (SELECT n_name AS name, coalesce(lang, '?') AS type, coalesce(source, '?') AS description, doc_id AS pos FROM documents JOIN nation ON n_nationkey = doc_id % 20)"
_MERGED = "kinds AS (SELECT name, type, count(*) AS n, min(pos) AS f FROM {0} GROUP BY ALL), nodes AS (SELECT name, first(type ORDER BY n DESC, f) AS type FROM kinds GROUP BY name)"


@query("m25_merge_entities", f"WITH {X.EDGES}, {_RECORDS}, {_MERGED.format('rec')}, ends AS (SELECT DISTINCT unnest([node1, node2]) AS name FROM edges WHERE node1 <> node2) SELECT name, type FROM nodes UNION ALL SELECT name, 'UNKNOWN' FROM ends WHERE name NOT IN (SELECT name FROM nodes)")
def _(t: Tables):
    return U.merge_graph(_records(t), X.edges(t))[0].select("name", "type")


@query("m25_merge_edges", f"WITH {X.EDGES} SELECT least(node1, node2) AS a, greatest(node1, node2) AS b, round(sum(weight), 6) AS weight FROM edges WHERE node1 <> node2 GROUP BY ALL")
def _(t: Tables):
    return U.merge_graph(_records(t), X.edges(t))[1].select("a", "b", "weight")


@query("m26_rebuild_entities", f"""WITH {X.EDGES}, {_RECORDS}, surv AS (SELECT * FROM rec WHERE description <> (SELECT min(description) FROM rec)), {_MERGED.format('surv')}, d AS (SELECT name, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description FROM surv GROUP BY name),
  e AS (SELECT unnest([node1, node2]) AS name, keywords FROM edges) SELECT name, type, description FROM nodes JOIN d USING (name) UNION ALL
  SELECT n_name, 'UNKNOWN', coalesce(string_agg(DISTINCT keywords, '<SEP>' ORDER BY keywords), '') FROM nation LEFT JOIN e ON e.name = n_name WHERE n_name NOT IN (SELECT name FROM nodes) GROUP BY n_name""")
def _(t: Tables):
    """Entities after the chunks of one source went: rebuilt from other records, or from their edges."""
    r = _records(t)
    gone = r.agg(F.min("description").alias("gone"))
    left = r.crossJoin(F.broadcast(gone)).where("description <> gone").drop("gone")  # one row
    names = t.nation.select(F.col("n_name").alias("name"))
    return U.rebuild_entities(names, left, X.edges(t).select("node1", "node2", F.col("keywords").alias("description")))


@query("m2_embed_rule", """WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark), s AS (SELECT item_id, ('0x' || substr(md5(t), 1, 6))::INT % 8 AS slot, count(*)::DOUBLE AS n FROM w GROUP BY ALL)
  SELECT item_id, list_transform(range(8), lambda i: coalesce((map_from_entries(list((slot, n))))[i], 0.0)) AS vector FROM s GROUP BY item_id""")
def _(t: Tables):
    return t.benchmark.where("text IS NOT NULL").select("item_id", rec.hashed_vector(F.expr("regexp_extract_all(lower(text), '[a-z0-9]+', 0)"), 8).alias("vector")).where("aggregate(vector, 0D, (s, x) -> s + x) > 0")


@query("m3_chunk_dual_write", "SELECT sha256(text) AS chunk_id, length(text) AS n, text <> '' AS embedded FROM benchmark WHERE text IS NOT NULL")
def _(t: Tables):
    c = t.benchmark.where("text IS NOT NULL").select(F.sha2("text", 256).alias("chunk_id"), F.col("text"), rec.hashed_vector(terms(F.col("text")), 8).alias("vector"))
    both = materialize(c, "chunks")  # one write holds the row and its vector
    return both.select("chunk_id", F.length("text").alias("n"), (F.size("vector") == 8).alias("embedded"))


@query("m4_absorbed_chunks", f"WITH {_NEAR} SELECT qid AS main, list(id ORDER BY score DESC, id) AS absorbed FROM near WHERE score >= 0.5 AND rank <= 3 GROUP BY qid")
def _(t: Tables):
    pairs = _near(t, 10).where("score >= 0.5").select(F.col("qid").alias("main"), F.col("id").alias("other"), "score")
    return U.absorb(pairs, 3)


@query("m5_topk_payload", f"WITH {_NEAR} SELECT qid, id, score, source FROM near LEFT JOIN documents ON doc_id = id WHERE rank <= 10")
def _(t: Tables):
    return _near(t, 10).join(t.documents.select(F.col("doc_id").alias("id"), "source"), "id", "left").select("qid", "id", "score", "source")


@query("m11_ordered_mappings", "SELECT c_name AS name, CASE WHEN c_nationkey < 10 THEN 'global' WHEN c_nationkey < 18 THEN 'round 1' ELSE 'round 2' END AS canonical FROM customer")
def _(t: Tables):
    c = t.customer
    return U.ordered_mappings([c.where(w).select(F.col("c_name").alias("name"), F.lit(v).alias("canonical")) for w, v in (("c_nationkey < 10", "global"), ("c_nationkey < 18", "round 1"), ("true", "round 2"))])


@query("m12_dataset_wipe", "SELECT 'chunks' AS kind, count(*) FILTER (source IS DISTINCT FROM 'web') AS n FROM documents UNION ALL SELECT 'tables', count(*) FROM documents WHERE source IS DISTINCT FROM 'web' AND text LIKE '%|%'")
def _(t: Tables):
    """Chunks and derived tables of one dataset go together."""
    d = t.documents.select("doc_id", F.coalesce("source", F.lit("")).alias("dataset"), "text")
    kinds = [("chunks", d), ("tables", d.where("text LIKE '%|%'"))]
    left = [writers.drop_dataset(x, "web").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, x in kinds]
    return left[0].unionByName(left[1])


@query("m15_final_answer", """WITH a AS (SELECT conv_id, turn, trim(text, ' ') AS answer FROM conversations WHERE role = 'assistant' AND trim(text, ' ') <> '') SELECT conv_id, arg_max(answer, turn) AS answer FROM a GROUP BY conv_id""")
def _(t: Tables):
    c = t.conversations.where("role = 'assistant'").select("conv_id", "turn", rec.final_answer(F.col("text")).alias("answer")).where("answer IS NOT NULL")
    return c.groupBy("conv_id").agg(F.max_by("answer", "turn").alias("answer"))


@query("m17_sql_fan_out", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def _(t: Tables):
    """One statement over several tables; what fails the guard or the table is left out."""
    return T.fan_out(t.spark, "SELECT count(*) AS n FROM {table}", {"nation": t.nation, "region": t.region, "missing": None})


@query("m18_placeholder_sql", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def _(t: Tables):
    return T.guarded_sql(t.spark, "SELECT n_regionkey, count(*) AS n FROM {table} GROUP BY n_regionkey", table=t.nation)


@query("m21_task_answers", f"WITH {_NEAR} SELECT vec_id AS task_id, coalesce(string_agg(id::VARCHAR, ',' ORDER BY rank) FILTER (score >= 0.3), '') AS answer FROM embeddings LEFT JOIN near ON qid = vec_id AND rank <= 3 WHERE vec_id % 100 = 0 GROUP BY vec_id")
def _(t: Tables):
    hits = _near(t, 3).where("score >= 0.3").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("h"))
    tasks = _queries(t).select(F.col("qid").alias("task_id"))
    found = hits.select(F.col("qid").alias("task_id"), F.array_join(F.transform("h", lambda x: x["id"].cast("string")), ",").alias("answer"))
    return tasks.join(found, "task_id", "left").select("task_id", F.coalesce("answer", F.lit("")).alias("answer"))


@query("m30_custom_chunks", "SELECT text, 'stored' AS kind FROM (SELECT DISTINCT text FROM benchmark) UNION ALL SELECT DISTINCT text, 'new' FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM benchmark)")
def _(t: Tables):
    stored = t.benchmark.select("text").distinct().withColumn("kind", F.lit("stored"))
    return writers.insert_missing(stored, t.documents.where("text IS NOT NULL").select("text", F.lit("new").alias("kind")), ["text"])


@query("m32_failed_records", "SELECT doc_id, 'failed' AS status, 'quality ' || quality AS error FROM labels WHERE quality = 0")
def _(t: Tables):
    return t.labels.where("quality = 0").select("doc_id", F.lit("failed").alias("status"), F.concat(F.lit("quality "), "quality").alias("error"))


@query("m38_captioned_log", "SELECT conv_id, turn, '[' || role || '] ' || text AS line FROM conversations UNION ALL SELECT page_id, 0, '[image] ' || url FROM pages")
def _(t: Tables):
    log = t.conversations.select("conv_id", "turn", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("line"))
    return log.unionByName(t.pages.select(F.col("page_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.concat(F.lit("[image] "), "url").alias("line")))


@query("m41_sheet_description", "SELECT 'n_nationkey' AS name, 'int' AS kind, list(n_nationkey::VARCHAR ORDER BY n_nationkey) AS samples FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'n_name', 'string', list(n_name ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'n_regionkey', 'int', list(n_regionkey::VARCHAR ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 3")
def _(t: Tables):
    return T.describe_sheet(t.nation, "n_nationkey", 3)


@query("m43_content_names", "SELECT doc_id, sha256(text) || '.txt' AS name FROM documents WHERE text IS NOT NULL")
def _(t: Tables):
    return t.documents.where("text IS NOT NULL").select("doc_id", rec.content_name(F.col("text"), "txt").alias("name"))


@query("p18_page_paths", "SELECT page_id, regexp_matches(url, '^[^/\\\\]') AND NOT regexp_matches(url, '(^|/)\\.\\.?(/|$)') AND regexp_matches(url, '[^/]\\.md$') AND NOT contains(url, '\\') AS plain, html IS NOT NULL AND trim(html) <> '' AS filled FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", rec.valid_page_path(F.col("url")).alias("plain"), (F.coalesce(F.trim("html"), F.lit("")) != "").alias("filled"))


@query("k8_vector_insert", "SELECT vec_id, count(*) AS n FROM (SELECT vec_id FROM embeddings UNION ALL SELECT vec_id + 1000000 FROM embeddings WHERE label = 1) GROUP BY vec_id")
def _(t: Tables):
    """Appended vectors are in the index as soon as their files are: the table is the index."""
    table = materialize(t.embeddings.select("vec_id", "embedding"), "vector-index")
    t.embeddings.where("label = 1").select(F.col("vec_id") + 1000000, "embedding").toDF("vec_id", "embedding").write.mode("append").parquet(table.materialized_at)
    return t.spark.read.schema(table.schema).parquet(table.materialized_at).groupBy("vec_id").agg(F.count("*").alias("n"))


@query("k9_graph_export", f"WITH {X.ENTITIES} SELECT '| ' || node_name || ' | ' || sub_type || ' |' AS line FROM ent")
def _(t: Tables):
    return X.entities(t).select(rec.markdown_row(F.col("node_name"), F.col("sub_type")).alias("line"))


@query("a10_batched_fold", "SELECT c_nationkey, ceil(count(*) / 70.0)::INT AS batches, sum(length(c_name))::INT AS chars FROM customer GROUP BY c_nationkey")
def _(t: Tables):
    g = t.customer.groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_name")).alias("names"))
    start = F.struct(F.lit(0).alias("batches"), F.lit(0).alias("chars"))
    folded = U.fold_batches(F.col("names"), 70, lambda acc, b: F.struct((acc["batches"] + 1).alias("batches"), (acc["chars"] + F.length(F.array_join(b, ""))).alias("chars")), start)
    return g.select("c_nationkey", folded.alias("f")).select("c_nationkey", "f.batches", "f.chars")


@query("a24_merge_ratio", "SELECT count(*) AS before, count(DISTINCT text) AS after, (count(*) - count(DISTINCT text))::DOUBLE / count(*) < 0.05 AS stops FROM documents WHERE text IS NOT NULL")
def _(t: Tables):
    d = t.documents.where("text IS NOT NULL")
    n, left = d.count(), d.select("text").distinct().count()  # two counts decide whether another round is due
    return t.spark.range(1).select(F.lit(n).cast("long").alias("before"), F.lit(left).cast("long").alias("after"), F.lit(U.converged(n, left)).alias("stops"))


@query("a29_token_usage", "SELECT role, count(*) AS calls, sum(len(regexp_extract_all(text, '[^ ]+')))::BIGINT AS tokens FROM conversations WHERE text IS NOT NULL GROUP BY role")
def _(t: Tables):
    return t.conversations.where("text IS NOT NULL").groupBy("role").agg(F.count("*").alias("calls"), F.sum(F.regexp_count("text", F.lit("[^ ]+"))).cast("long").alias("tokens"))


@query("a30_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t: Tables):
    c = t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.grouping_id().alias("level"))
    return c.select("l_returnflag", "l_linestatus", "n", "suppliers", "level")


@query("w13_window_frames", """SELECT o_orderkey, lag(o_totalprice) OVER w AS previous, lead(o_totalprice) OVER w AS following, ntile(4) OVER w AS quarter, count(*) OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate)::BIGINT RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW) AS month
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def _(t: Tables):
    w = R.W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    month = R.W.partitionBy("o_custkey").orderBy(F.unix_timestamp("o_orderdate")).rangeBetween(-30 * 86400, 0)
    return t.orders.select("o_orderkey", F.lag("o_totalprice").over(w).alias("previous"), F.lead("o_totalprice").over(w).alias("following"), F.ntile(4).over(w).alias("quarter"), F.count("*").over(month).alias("month"))


# --- files: written to the shared folder and read back


def _written(t: Tables, df, name: str, form: str, **options) -> str:
    path = f"{materialize(df.limit(0), name).materialized_at}-{form}"
    df.write.options(**options).format(form).save(path)
    return path


@query("s9_jsonl", "SELECT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL")
def _(t: Tables):
    """Good lines among malformed and blank ones."""
    lines = t.benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.to_json(F.struct("item_id", "text")).alias("value"))
    noise = t.region.select(F.concat(F.lit('{"item_id": '), "r_name").alias("value"))
    return readers.read_jsonl(t.spark, _written(t, lines.unionByName(noise), "jsonl", "text"), "item_id long, text string").where("item_id IS NOT NULL")


@query("s3_text_files", "SELECT n_name AS text FROM nation")
def _(t: Tables):
    path = _written(t, t.nation.select(F.col("n_name").alias("value"), "n_nationkey").repartition(25, "n_nationkey").select("value"), "texts", "text")
    docs = readers.read_text_documents(t.spark, path)
    text = F.explode(F.split(F.col("pages")["page_0"][0]["text"], "\n")).alias("text")
    return docs.select(text).where("text <> ''")


@query("s5_sheet", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def _(t: Tables):
    return readers.read_sheet(t.spark, _written(t, t.nation.select("n_nationkey", "n_name"), "sheet", "csv", header=True))


@query("s14_local_nodes", f"WITH {X.ENTITIES} SELECT node_id AS Id, node_name, description FROM ent")
def _(t: Tables):
    e = X.entities(t).select(F.col("node_id").alias("ID"), "node_name", "description")
    return readers.unify_keys(t.spark.read.json(_written(t, e, "nodes", "json"))).where("node_name <> ''").select("Id", "node_name", "description")


@query("s17_taxonomy", "SELECT n_nationkey, r_name, n_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(t: Tables):
    """Upper levels stand only in a group's first row; rows blank in every level go."""
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    first = F.row_number().over(R.W.partitionBy("r_name").orderBy("n_nationkey")) == 1
    rows = n.select(F.col("n_regionkey").alias("grp"), "n_nationkey", F.when(first, F.col("r_name")).alias("r_name"), "n_name")
    blank = t.region.select(F.col("r_regionkey").alias("grp"), F.lit(None).cast("int").alias("n_nationkey"), F.lit("").alias("r_name"), F.lit(" ").alias("n_name"))
    order = F.concat_ws("-", "grp", F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    return readers.fill_down_taxonomy(rows.unionByName(blank).withColumn("at", order), "at", ["r_name", "n_name"]).select("n_nationkey", "r_name", "n_name")


@query("s22_graph_files", f"WITH {X.ENTITIES} SELECT node_id, node_name FROM ent")
def _(t: Tables):
    return readers.read_jsonl(t.spark, _written(t, X.entities(t).select("node_id", "node_name"), "graph", "json"), "node_id string, node_name string")


@query("k1_rolled_files", "SELECT count(*) AS n, count(*) >= 15 AS rolled FROM customer")
def _(t: Tables):
    path = f"{materialize(t.customer.limit(0), 'rolled').materialized_at}-json"
    writers.write_rolled_jsonl(t.customer.repartition(t.spark.sparkContext.defaultParallelism), path, 10)  # all tasks write
    files = t.spark.read.json(path, schema="c_custkey long").select("c_custkey", F.input_file_name().alias("f"))
    return files.agg(F.count("*").alias("n"), (F.countDistinct("f") >= F.ceil(F.count("*") / 10)).alias("rolled"))


@query("m42_merged_files", "SELECT item_id FROM benchmark WHERE item_id IS NOT NULL UNION ALL SELECT item_id FROM benchmark WHERE item_id IS NOT NULL")
def _(t: Tables):
    """Intermediate files, some empty, read as one and rolled anew."""
    one = t.benchmark.where("item_id IS NOT NULL").select("item_id")
    paths = [_written(t, x, "part", "json") for x in (one, one.limit(0), one)]
    return readers.read_jsonl(t.spark, paths, "item_id long")


@query("p10_sql_guard", "SELECT doc_id, doc_id % 6 IN (0, 2, 4) AS allowed FROM documents")
def _(t: Tables):
    """Statements that a model might write around a document's text: data inside quotes is no keyword, keywords outside are."""
    said = F.concat(F.lit("'"), F.replace(F.coalesce("text", F.lit("")), F.lit("'"), F.lit("''")), F.lit(" DELETE; x'"))
    around = [("SELECT created_at FROM t WHERE x = ", ""), ("DELETE FROM t WHERE x = ", ""), ("with a AS (SELECT 1) SELECT ", " FROM a;"), ("SELECT ", "; SELECT 2"), ("select /* drop */ ", " as word"), ("select * from (delete from x) where y = ", "")]
    sql = F.lit(None).cast("string")
    for n, (before, after) in enumerate(around):
        sql = F.when(F.col("doc_id") % 6 == n, F.concat(F.lit(before), said, F.lit(after))).otherwise(sql)
    return t.documents.select("doc_id", T.read_only_column(sql).alias("allowed"))
