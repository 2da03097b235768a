"""Queries of search, fusion and context assembly."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.vectors import cosine, inner_product, l2_normalize, norm, or_zero, shifted_cosine
from lakeloom.operators import retrieval as R
from lakeloom.plans import fixtures as X
from lakeloom.plans.registry import Tables, query

_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_NORM = "sqrt(list_inner_product({0}.embedding::DOUBLE[], {0}.embedding::DOUBLE[]))"
_COS = f"({_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}))"
VEC = f"vec AS (SELECT a.vec_id, round({_DOT}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0)"


def _vec(t: Tables, k: int):
    return R.vector_top_k(t.embeddings, X.query_vector(t), k)


@query("j9_vector_topk", f"WITH {VEC} SELECT * FROM vec ORDER BY score DESC, vec_id LIMIT 10")
def _(t: Tables):
    return _vec(t, 10)


@query("j9_vector_topk_batch", f"""SELECT * FROM (SELECT a.vec_id AS qid, b.vec_id, round({_COS}, 6) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0) WHERE rank <= 5""")
def _(t: Tables):
    q = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), "label")
    return R.vector_top_k_batch(t.embeddings, q, 5, "label")


@query("p3_score_threshold", f"WITH {VEC} SELECT * FROM vec WHERE score >= 0.2")
def _(t: Tables):
    v = t.embeddings.crossJoin(F.broadcast(X.query_vector(t)))
    return v.select("vec_id", F.round(inner_product("embedding", "q"), 6).alias("score")).where("score >= 0.2")


@query("p4_cosine_cutoff", f"SELECT a.vec_id FROM embeddings a, embeddings b WHERE b.vec_id = 1 AND round({_COS}, 6) > 0.2")
def _(t: Tables):
    return t.embeddings.crossJoin(F.broadcast(X.query_vector(t, 1))).where(F.round(cosine("embedding", "q"), 6) > 0.2).select("vec_id")


@query("f30_inner_product", f"SELECT a.vec_id, round({_DOT}, 6) AS ip FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t: Tables):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return t.embeddings.join(b, "vec_id").select("vec_id", F.round(inner_product("embedding", "b"), 6).alias("ip"))


@query("f31_cosine", f"SELECT a.vec_id, round({_COS}, 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t: Tables):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return t.embeddings.join(b, "vec_id").select("vec_id", F.round(cosine("embedding", "b"), 6).alias("cos"))


@query("f32_l2_normalize", f"SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x / {_NORM.format('embeddings')}))), 6) AS l1, round({_NORM.format('embeddings')}, 6) AS norm FROM embeddings")
def _(t: Tables):
    unit = l2_normalize("embedding")
    return t.embeddings.select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1"), F.round(norm("embedding"), 6).alias("norm"))


@query("f33_shifted_cosine", f"SELECT a.vec_id, round(2 * {_COS} - 1, 4) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t: Tables):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return t.embeddings.join(b, "vec_id").select("vec_id", shifted_cosine("embedding", "b").alias("sim"))


@query("f34_rounded_scores", f"SELECT a.vec_id, round({_DOT}, 4) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 2")
def _(t: Tables):
    return t.embeddings.crossJoin(F.broadcast(X.query_vector(t, 2))).select("vec_id", F.round(inner_product("embedding", "q"), 4).alias("score"))


@query("f35_zero_fallback", "SELECT doc_id, CASE WHEN vec_id IS NULL THEN 64 ELSE len(list_filter(embedding, lambda x: x = 0)) END AS zeros FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def _(t: Tables):
    d = t.documents.select("doc_id").join(t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    return d.select("doc_id", F.size(F.filter(or_zero("embedding", 64), lambda x: x == 0)).alias("zeros"))


@query("f19_fulltext_and", f"WITH {X.bm25_cte(('the', 'heed'), 'matched = 2')} SELECT doc_id, score FROM bm25 ORDER BY score DESC, doc_id LIMIT 200")
def _(t: Tables):
    return R.top_k(R.bm25(t.documents, ["the", "heed"], all_terms=True), 200, F.desc("score"), F.col("doc_id")).select("doc_id", "score")


@query("f19_bm25", f"WITH {X.bm25_cte()} SELECT doc_id, score FROM bm25 ORDER BY score DESC, doc_id LIMIT 50")
def _(t: Tables):
    return R.top_k(R.bm25(t.documents, list(X.SEARCH)), 50, F.desc("score"), F.col("doc_id")).select("doc_id", "score")


@query("f19_postings", f"SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len({X.TERMS}) AS dl, unnest({X.TERMS}) AS term FROM documents) GROUP BY ALL")
def _(t: Tables):
    return R.postings(t.documents)


@query("f20_bm25_triples", """WITH d AS (SELECT c_custkey AS id, [c_name, c_mktsegment, n_name] AS fields FROM customer JOIN nation ON c_nationkey = n_nationkey),
  q AS (SELECT unnest(string_split('BUILDING MACHINERY NATION_3', ' ')) AS w),
  df AS (SELECT w, count(*) AS df FROM q JOIN d ON list_contains(fields, w) GROUP BY w), n AS (SELECT count(*) AS n FROM d),
  s AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5)) AS s FROM d JOIN df ON list_contains(fields, w), n GROUP BY id)
  SELECT id, round(s, 6) AS score FROM s ORDER BY score DESC, id LIMIT 5""")
def _(t: Tables):
    d = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.explode(F.array("c_name", "c_mktsegment", "n_name")).alias("w"))
    q = t.spark.createDataFrame([(w,) for w in "BUILDING MACHINERY NATION_3".split(" ")], "w string")
    hit = d.join(F.broadcast(q), "w")  # the query's words
    df = hit.groupBy("w").agg(F.count("*").alias("df")).crossJoin(F.broadcast(t.customer.agg(F.count("*").alias("n"))))
    score = F.sum(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * 2.5 / (1 + 1.5))
    return R.top_k(hit.join(F.broadcast(df), "w").groupBy("id").agg(F.round(score, 6).alias("score")), 5, F.desc("score"), F.col("id"))


_LISTS = f"""{VEC}, {X.bm25_cte()}, v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT * FROM vec ORDER BY score DESC, vec_id LIMIT 200)),
  b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM bm25 ORDER BY score DESC, doc_id LIMIT 200)),
  fused AS (SELECT id, round(sum(1 / (60 + rank)), 8) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM b) GROUP BY id)"""
_OCC = "occ AS (SELECT chunk_id AS id, count(*) AS n FROM bridge JOIN ent ON cluster_id = node_id WHERE sub_type = 'ASIA' GROUP BY 1)"


def _lists(t: Tables):
    v = R.ranked(_vec(t, 200), "vec_id", list_name="vector")
    words = R.top_k(R.bm25(t.documents, list(X.SEARCH)), 200, F.desc("score"), F.col("doc_id"))
    return v.unionByName(R.ranked(words, "doc_id", list_name="words"))


def _occurrences(t: Tables):
    e = X.entities(t).where("sub_type = 'ASIA'").select(F.col("node_id").alias("cluster_id"))
    return X.bridge(t).join(F.broadcast(e), "cluster_id").groupBy(F.col("chunk_id").alias("id")).agg(F.count("*").alias("n"))  # a region's nations


@query("w1_rank_positions", f"WITH {_LISTS} SELECT 'vector' AS list, id, rank FROM v UNION ALL SELECT 'words', id, rank FROM b")
def _(t: Tables):
    return _lists(t)


@query("a4_rrf", f"WITH {_LISTS} SELECT * FROM fused")
def _(t: Tables):
    return R.rrf(_lists(t))


@query("a5_kg_boost", f"WITH {_LISTS}, {X.ENTITIES}, {X.BRIDGE}, {_OCC} SELECT coalesce(fused.id, occ.id) AS id, round(coalesce(score, 0) + coalesce(n, 0) * 1.0::DOUBLE / 60, 8) AS score FROM fused FULL JOIN occ ON fused.id = occ.id")
def _(t: Tables):
    return R.kg_boost(R.rrf(_lists(t)), _occurrences(t))


@query("a6_cross_dataset_rrf", """WITH r AS (SELECT source AS ds, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
  SELECT id % 40 AS key, round(sum(1 / (60 + rank)), 8) AS score FROM r WHERE rank <= 20 GROUP BY 1""")
def _(t: Tables):
    r = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    d = t.documents.select((F.col("doc_id") % 40).alias("id"), r.alias("rank")).where("rank <= 20")
    return R.rrf(d).withColumnRenamed("id", "key")


@query("hybrid_rrf_topk", f"WITH {_LISTS} SELECT * FROM fused ORDER BY score DESC, id LIMIT 10")
def _(t: Tables):
    return R.top_k(R.rrf(_lists(t)), 10, F.desc("score"), F.col("id"))


@query("a1_occurrences", f"WITH {X.ENTITIES}, {X.BRIDGE}, {_OCC} SELECT * FROM occ")
def _(t: Tables):
    return _occurrences(t)


_A2 = "a2 AS (SELECT occ.id, round(coalesce(score, 0) * 1.5 + n * 1.0, 8) AS score FROM occ LEFT JOIN vec ON vec_id = occ.id)"


@query("a2_composite_score", f"WITH {VEC}, {X.ENTITIES}, {X.BRIDGE}, {_OCC}, {_A2} SELECT * FROM a2")
def _(t: Tables):
    sims = t.embeddings.crossJoin(F.broadcast(X.query_vector(t))).select(F.col("vec_id").alias("id"), F.round(inner_product("embedding", "q"), 6).alias("sim"))
    return R.composite(sims, _occurrences(t))


@query("r1_naive_mode", f"WITH {VEC}, {X.ENTITIES}, {X.BRIDGE}, {_OCC}, {_A2} SELECT id, round(score * 1.5 + 1.0, 8) AS score FROM a2 ORDER BY score DESC, id LIMIT 20")
def _(t: Tables):
    sims = t.embeddings.crossJoin(F.broadcast(X.query_vector(t))).select(F.col("vec_id").alias("id"), F.round(inner_product("embedding", "q"), 6).alias("sim"))
    per = R.composite(sims, _occurrences(t)).withColumn("dataset_pos", F.lit(0))
    return R.top_k(R.rescore(per), 20, F.desc("score"), F.col("id"))


@query("a3_global_rescore", "SELECT doc_id % 100 AS id, round(arg_max(n_chars::DOUBLE, doc_id) * 1.5 + 1.0, 8) AS score FROM documents GROUP BY 1")
def _(t: Tables):
    d = t.documents.select((F.col("doc_id") % 100).alias("id"), F.col("n_chars").cast("double").alias("score"), F.col("doc_id").alias("dataset_pos"))
    return R.rescore(d)


@query("r2_rerank_mode", f"""WITH {_LISTS}, {X.ENTITIES}, {X.BRIDGE}, {_OCC},
  boosted AS (SELECT coalesce(fused.id, occ.id) AS id, round(coalesce(score, 0) + coalesce(n, 0) * 1.0::DOUBLE / 60, 8) AS score FROM fused FULL JOIN occ ON fused.id = occ.id),
  cut AS (SELECT * FROM boosted ORDER BY score DESC, id LIMIT 30)
  SELECT id, score, coalesce(substr(text, 1, 20), 'not_found') AS start FROM cut LEFT JOIN documents ON doc_id = id ORDER BY score DESC, id LIMIT 10""")
def _(t: Tables):
    cut = R.top_k(R.kg_boost(R.rrf(_lists(t)), _occurrences(t)), min(3 * 10, 50), F.desc("score"), F.col("id"))
    found = cut.join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id", "left")
    found = found.select("id", "score", F.coalesce(F.substring("text", 1, 20), F.lit("not_found")).alias("start"))
    return R.top_k(found, 10, F.desc("score"), F.col("id"))


@query("t1_topk", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def _(t: Tables):
    return R.top_k(t.documents.select("doc_id", "n_chars"), 25, F.desc("n_chars"), F.col("doc_id"))


@query("t3_kg_split", f"WITH {X.ENTITIES}, {X.EDGES} SELECT * FROM (SELECT 'entity' AS kind, node_name AS name FROM ent ORDER BY node_name LIMIT 5) UNION ALL SELECT * FROM (SELECT 'relation', node1 || '-' || node2 AS name FROM edges ORDER BY name LIMIT 6)")
def _(t: Tables):
    k = 11
    e = X.entities(t).orderBy("node_name").limit(k // 2).select(F.lit("entity").alias("kind"), F.col("node_name").alias("name"))
    r = X.edges(t).select(F.lit("relation").alias("kind"), F.concat_ws("-", "node1", "node2").alias("name")).orderBy("name").limit(k - k // 2)
    return e.unionByName(r)


@query("t6_multi_dataset_topk", """WITH r AS (SELECT source, lang, n_chars, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents)
  SELECT lang, n_chars, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS first FROM r WHERE rn <= 10) WHERE first = 1""")
def _(t: Tables):
    rn = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    d = t.documents.select("source", "lang", "n_chars", "doc_id", rn.alias("rn")).where("rn <= 10")
    best = d.groupBy("lang").agg(F.max_by(F.struct("n_chars", "doc_id"), F.struct(F.col("n_chars"), -F.col("doc_id"))).alias("b"))
    return best.select("lang", "b.n_chars", "b.doc_id")


@query("t11_pagination", "SELECT doc_id, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40")
def _(t: Tables):
    total = t.documents.agg(F.count("*").alias("total"))
    return t.documents.select("doc_id").orderBy("doc_id").offset(40).limit(20).crossJoin(F.broadcast(total))


@query("t14_sources_by_count", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source")
def _(t: Tables):
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("w2_first_occurrence", "SELECT lang, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS rn FROM documents) WHERE rn = 1")
def _(t: Tables):
    d = t.documents.withColumn("k", F.concat_ws("|", "lang", "source"))
    return R.first_occurrence(d, "k", "n_chars", "doc_id").select("lang", "doc_id", "source")


@query("w3_count_then_sort", """SELECT doc_id, source, cnt, row_number() OVER (PARTITION BY source ORDER BY cnt DESC, doc_id) AS pos
  FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY md5(text)) AS cnt FROM documents)""")
def _(t: Tables):
    h = t.documents.select("doc_id", "source", F.md5("text").alias("h"))
    d = h.join(h.groupBy("h").agg(F.count("*").alias("cnt")), "h")
    return d.select("doc_id", "source", "cnt", F.row_number().over(W.partitionBy("source").orderBy(F.desc("cnt"), "doc_id")).alias("pos"))


_GROUPS = "g0 AS (SELECT (CASE WHEN doc_id % 7 = 2 AND doc_id >= 10 THEN 0 ELSE doc_id % 7 END)::BIGINT AS grp, doc_id AS chunk_id FROM documents), g AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY chunk_id) AS rn FROM g0)"


@query("w4_weighted_polling", f"""WITH {_GROUPS}, c AS (SELECT *, round_even(5.0::DOUBLE - grp / 6::DOUBLE * 4, 0)::BIGINT AS quota FROM g),
  u AS (SELECT sum(q - used) AS spare FROM (SELECT grp, any_value(quota) AS q, least(max(rn), any_value(quota)) AS used FROM c GROUP BY grp)),
  a AS (SELECT grp, rn, chunk_id, 0 AS pass FROM c WHERE rn <= quota),
  b AS (SELECT grp, rn, chunk_id, 1 AS pass FROM (SELECT *, row_number() OVER (ORDER BY grp, rn) AS turn FROM c WHERE rn > quota), u WHERE turn <= spare)
  SELECT *, row_number() OVER (ORDER BY pass, grp, rn) AS pos FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def _(t: Tables):
    d = t.documents.select(F.when(F.expr("doc_id % 7 = 2 AND doc_id >= 10"), F.lit(0)).otherwise(F.col("doc_id") % 7).alias("grp"), F.col("doc_id").alias("chunk_id"))
    d = d.withColumn("rn", F.row_number().over(W.partitionBy("grp").orderBy("chunk_id")))
    return R.weighted_polling(d, 7)


@query("w5_round_robin", f"""WITH {_LISTS}, u AS (SELECT 0 AS l, id, rank FROM v WHERE rank <= 40 UNION ALL SELECT 1, id, rank FROM b WHERE rank <= 40),
  f AS (SELECT id, min(rank * 10 + l) AS spot FROM u GROUP BY id) SELECT id, row_number() OVER (ORDER BY spot, id) AS pos FROM f""")
def _(t: Tables):
    u = _lists(t).where("rank <= 40").select(F.when(F.col("list") == "vector", 0).otherwise(1).alias("list_no"), "id", "rank")
    return R.interleave(u)


@query("w6_token_budget", """SELECT doc_id, source FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE s <= 20000""")
def _(t: Tables):
    d = t.documents.select("doc_id", "source", F.col("n_chars").alias("tokens"))
    return R.token_budget(d, 20000, "doc_id", group=["source"]).select("doc_id", "source")


@query("w12_citation_numbers", "SELECT doc_id, dense_rank() OVER (ORDER BY source) AS citation, '[' || dense_rank() OVER (ORDER BY source) || '] ' || substr(text, 1, 10) AS line FROM documents")
def _(t: Tables):
    s = t.documents.select("source").distinct()
    s = s.withColumn("citation", F.row_number().over(W.orderBy("source")))  # one row a source
    d = t.documents.join(s, "source")
    return d.select("doc_id", "citation", F.concat(F.lit("["), "citation", F.lit("] "), F.substring("text", 1, 10)).alias("line"))


@query("j18_citation_join", """WITH f AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY source),
  o AS (SELECT source, row_number() OVER (ORDER BY first) AS idx FROM f) SELECT doc_id, idx FROM documents JOIN o USING (source)""")
def _(t: Tables):
    f = t.documents.groupBy("source").agg(F.min("doc_id").alias("first"))
    f = f.select("source", F.row_number().over(W.orderBy("first")).alias("idx"))
    return t.documents.join(f, "source").select("doc_id", "idx")


@query("j5_bridge_join", f"WITH {X.ENTITIES}, {X.BRIDGE} SELECT cluster_id, chunk_id FROM bridge JOIN ent ON cluster_id = node_id WHERE sub_type = 'EUROPE'")
def _(t: Tables):
    e = X.entities(t).where("sub_type = 'EUROPE'").select(F.col("node_id").alias("cluster_id"))
    return X.bridge(t).join(e, "cluster_id").select("cluster_id", "chunk_id")


@query("j6_chunk_lookup", "SELECT i AS id, CASE WHEN doc_id IS NULL THEN 'not_found' ELSE 'found' END AS status, n_chars FROM (SELECT unnest(range(0, 2000, 7)) AS i) LEFT JOIN documents ON doc_id = i")
def _(t: Tables):
    ids = t.spark.range(0, 2000, 7)
    d = ids.join(t.documents.select(F.col("doc_id").alias("id"), "n_chars", F.lit("found").alias("status")), "id", "left")
    return d.select("id", F.coalesce("status", F.lit("not_found")).alias("status"), "n_chars")


@query("p6_membership", "SELECT doc_id, lang FROM documents WHERE doc_id IN (1, 5, 9, 700)")
def _(t: Tables):
    return t.documents.where(F.col("doc_id").isin(1, 5, 9, 700)).select("doc_id", "lang")


@query("p8_cross_source_cutoff", f"WITH {VEC}, m AS (SELECT min(score) AS s FROM (SELECT score FROM vec ORDER BY score DESC, vec_id LIMIT 50)) SELECT vec_id, score FROM vec, m WHERE score * 1.5 > s")
def _(t: Tables):
    v = t.embeddings.crossJoin(F.broadcast(X.query_vector(t))).select("vec_id", F.round(inner_product("embedding", "q"), 6).alias("score"))
    least = _vec(t, 50).agg(F.min("score").alias("s"))  # a22: one row
    return v.crossJoin(F.broadcast(least)).where("score * 1.5 > s").select("vec_id", "score")


@query("p15_listing", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 50")
def _(t: Tables):
    page, size = max(1, 2), min(max(50, 10), 200)
    d = t.documents.where("lang = 'en'").select("doc_id", "lang", "n_chars")
    return d.orderBy(F.desc("n_chars"), "doc_id").offset((page - 1) * size).limit(size)


@query("p16_keyword_containment", """WITH d AS (SELECT item_id, string_split(text, ' ')[1:3] AS kw, lower(text) AS tx FROM benchmark)
  SELECT item_id, len(list_filter(kw, lambda k: contains(tx, lower(k)))) = len(kw) AS passed, len(list_filter(kw, lambda k: NOT contains(tx, lower(k)))) AS missing FROM d""")
def _(t: Tables):
    d = t.benchmark.select("item_id", F.slice(F.split("text", " "), 1, 3).alias("kw"), F.lower("text").alias("tx"))
    hit = lambda k: F.contains(F.col("tx"), F.lower(k))
    return d.select("item_id", F.forall("kw", hit).alias("passed"), F.size(F.filter("kw", lambda k: ~hit(k))).alias("missing"))


@query("p17_min_rerank_score", f"WITH {VEC} SELECT doc_id, coalesce(score, 1.0) AS score FROM documents LEFT JOIN vec ON vec_id = doc_id WHERE coalesce(score, 1.0) >= 0.3")
def _(t: Tables):
    v = t.embeddings.crossJoin(F.broadcast(X.query_vector(t))).select(F.col("vec_id").alias("doc_id"), F.round(inner_product("embedding", "q"), 6).alias("score"))
    d = t.documents.select("doc_id").join(v, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(1.0)))
    return d.where("score >= 0.3")


@query("a22_min_score", f"WITH {VEC} SELECT min(score) AS cutoff FROM (SELECT score FROM vec ORDER BY score DESC, vec_id LIMIT 10)")
def _(t: Tables):
    return _vec(t, 10).agg(F.min("score").alias("cutoff"))


@query("w11_best_match", f"""SELECT qid, vec_id, score FROM (SELECT a.vec_id AS qid, b.vec_id, round({_COS}, 6) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS rn
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rn = 1""")
def _(t: Tables):
    q = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), "label")
    return R.best_other(t.embeddings, q, "label")
