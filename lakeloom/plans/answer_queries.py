"""Whole answers: the document mode with its reranker, sources asked in turn, tables filled by search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.text import terms
from lakeloom.functions.vectors import cosine
from lakeloom.operators import answering as A
from lakeloom.operators import tables as T
from lakeloom.operators.model_slots import Slot
from lakeloom.operators.retrieval import vector_top_k_batch
from lakeloom.operators.text_index import TextIndex
from lakeloom.plans import fixtures as X
from lakeloom.plans.evidence_queries import _WORDS, _broken, _overlap, _shorter
from lakeloom.plans.registry import Tables, query
from lakeloom.plans.store_queries import fresh

_COS = "round(list_inner_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_inner_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_inner_product({1}::DOUBLE[], {1}::DOUBLE[]))), 6)"
_BM25 = f"""p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({X.TERMS}) AS term FROM documents) GROUP BY ALL),
  d AS (SELECT doc_id, len({X.TERMS}) AS dl FROM documents), one AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  bt AS (SELECT DISTINCT item_id AS qid, unnest({X.TERMS}) AS term FROM benchmark),
  bs AS (SELECT qid, doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM bt JOIN f USING (term) JOIN p USING (term) JOIN d USING (doc_id), one GROUP BY qid, doc_id),
  bm AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bs)"""
_QUESTIONS = "ask AS (SELECT item_id AS qid, text AS query, embedding AS q, label FROM benchmark JOIN embeddings ON vec_id = item_id * 10)"


def questions(t: Tables):
    """Benchmark texts, each with the vector of ten times its id."""
    v = t.embeddings.select((F.col("vec_id") / 10).alias("item_id"), F.col("embedding").alias("q"), "label")
    return t.benchmark.select("item_id", F.col("text").alias("query")).join(v, "item_id").withColumnRenamed("item_id", "qid")


def word_hits(t: Tables, asked, k: int):
    index = TextIndex(t.spark, fresh(t, "text-index"), 16)
    index.insert(t.documents)
    return index.search(asked.select("qid", F.explode(terms(F.col("query"))).alias("term")), k)


@query("r2_document_answers", f"""WITH {_QUESTIONS}, {_BM25},
  v AS (SELECT qid, vec_id AS id, row_number() OVER (PARTITION BY qid ORDER BY {_COS.format("embedding", "q")} DESC, vec_id) AS rank FROM embeddings, (SELECT qid, q FROM ask) QUALIFY rank <= 50),
  parts AS (SELECT qid, id, 1 / (60.0::DOUBLE + rank) AS s FROM v UNION ALL SELECT qid, id, 1 / (60.0::DOUBLE + rank) FROM bm WHERE rank <= 50 UNION ALL SELECT qid, doc_id, 1 / 60.0::DOUBLE FROM ask JOIN documents ON doc_id % 25 = qid % 25),
  fu AS (SELECT qid, id, round(sum(s), 8) AS score FROM parts GROUP BY ALL),
  cut AS (SELECT qid, id, score, coalesce(ask.query, '') AS q, documents.text AS t, qid % 3 AS m, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fu JOIN ask USING (qid) JOIN documents ON doc_id = id WHERE documents.text IS NOT NULL QUALIFY rank <= 24),
  w AS (SELECT *, {_WORDS.format("q")} AS a, {_WORDS.format("t")} AS b FROM cut),
  s AS (SELECT *, CASE m WHEN 0 THEN CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b)) / len(a), 6) ELSE 0.0 END WHEN 1 THEN -length(t)::DOUBLE END AS model_score FROM w)
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY -model_score, rank, id) AS pos, id, score, model_score, m = 2 AS fell_back FROM s QUALIFY pos <= 8""")
def _(t: Tables):
    """Vector hits, word hits and documents that the graph mentions, fused; three modes, one of whose models always fails."""
    asked = questions(t)
    mode = F.when(F.col("qid") % 3 == 0, "words").when(F.col("qid") % 3 == 1, "short").otherwise("broken")
    vectors = vector_top_k_batch(t.embeddings.select("vec_id", "embedding"), asked.select("qid", "q"), 50).select("qid", F.col("vec_id").alias("id"), "rank")
    at = t.documents.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 25).alias("part"))
    mentions = asked.select("qid", (F.col("qid") % 25).alias("part")).join(at, "part").select("qid", "id", F.lit(1).alias("n"))
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")
    slots = {"words": Slot(_overlap), "short": Slot(_shorter, max_rows=7), "broken": Slot(_broken, retries=1)}
    return A.document_answers(asked.withColumn("mode", mode), [vectors, word_hits(t, asked, 50)], mentions, texts, 8, slots)


_FACTS = f"""fact AS (SELECT qid, vec_id AS id, {_COS.format("embedding", "q")} AS score FROM ask JOIN embeddings e ON e.label = ask.label WHERE vec_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) = 1)"""
_GRAPH = f"""ne AS (SELECT qid, n_name, {_COS.format("embedding", "q")} AS score FROM ask, embeddings JOIN nation ON n_nationkey = vec_id QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, n_name) = 1),
  {X.EDGES}, touch AS (SELECT qid, score, n_name, weight, CASE WHEN node1 = n_name THEN node2 ELSE node1 END AS other FROM ne JOIN edges ON n_name IN (node1, node2)),
  gr AS (SELECT qid, score, n_name || ' - ' || other AS answer FROM touch QUALIFY row_number() OVER (PARTITION BY qid ORDER BY weight DESC, other) = 1)"""


def graph_answers(t: Tables):
    """The nation whose vector is nearest to a question, and its heaviest relation."""

    def ask(q):
        n = t.embeddings.select(F.col("vec_id").cast("int").alias("n_nationkey"), "embedding").join(t.nation.select("n_nationkey", "n_name"), "n_nationkey")
        near = n.crossJoin(q.select("qid", "q")).select("qid", "n_name", F.round(cosine("embedding", "q"), 6).alias("score"))  # the open questions against all entities
        best = near.groupBy("qid").agg(F.min(F.struct((-F.col("score")).alias("s"), "n_name")).alias("b")).select("qid", (-F.col("b.s")).alias("score"), F.col("b.n_name").alias("name"))
        e = X.edges(t)
        ends = e.select(F.col("node1").alias("name"), F.col("node2").alias("other"), "weight").unionByName(e.select(F.col("node2").alias("name"), F.col("node1").alias("other"), "weight"))
        return best.join(ends, "name").select("qid", "score", F.struct((-F.col("weight")).alias("w"), "other").alias("at"), F.concat_ws(" - ", "name", "other").alias("answer"))

    return ask


@query("r19_sources_in_turn", f"""WITH {_QUESTIONS}, {_BM25}, {_FACTS}, {_GRAPH}, u AS (SELECT qid, 1 AS tried, 'facts' AS stage, 'fact ' || id AS answer FROM fact WHERE score >= 0.35
    UNION ALL SELECT qid, 2, 'graph', answer FROM gr WHERE score >= 0.3 UNION ALL SELECT qid, 3, 'documents', 'document ' || id FROM bm WHERE rank = 1 AND score >= 15)
  SELECT qid, arg_min(stage, tried) AS stage, arg_min(answer, tried) AS answer, coalesce(min(tried), 3)::INTEGER AS tried FROM ask LEFT JOIN u USING (qid) GROUP BY qid""")
def _(t: Tables):
    """Fact memory by vector, the graph, then the full-text index; each is asked what is still open."""

    def facts(q):
        hits = vector_top_k_batch(t.embeddings.where("vec_id % 10 <> 0").select("vec_id", "embedding", "label"), q.select("qid", "q", "label"), 1, "label")
        return hits.select("qid", "score", F.concat(F.lit("fact "), F.col("vec_id").cast("string")).alias("answer"))

    def documents(q):
        return word_hits(t, q, 1).select("qid", "score", F.concat(F.lit("document "), F.col("id").cast("string")).alias("answer"))

    stages = [A.Stage("facts", facts, F.col("score") >= 0.35), A.Stage("graph", graph_answers(t), F.col("score") >= 0.3, "at"), A.Stage("documents", documents, F.col("score") >= 15)]
    return A.ask_in_turn(questions(t), stages)


@query("m37_judged_answers", f"""WITH {_QUESTIONS}, {_GRAPH}, said AS (SELECT conv_id AS qid, arg_max(trim(text, ' '), turn) AS answer FROM conversations WHERE role = 'assistant' AND trim(text, ' ') <> '' GROUP BY conv_id),
  j AS (SELECT qid, answer, len(list_intersect(list_distinct(regexp_extract_all(lower(answer), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')))) AS shared FROM said JOIN ask USING (qid)),
  u AS (SELECT qid, 1 AS tried, 'parametric' AS stage, answer FROM j WHERE shared >= 8 UNION ALL SELECT qid, 2, 'graph', answer FROM gr)
  SELECT qid, arg_min(stage, tried) AS stage, arg_min(answer, tried) AS answer, coalesce(min(tried), 2)::INTEGER AS tried FROM ask LEFT JOIN u USING (qid) GROUP BY qid""")
def _(t: Tables):
    """A model's own answer where a judge finds that it speaks of the question (eight words shared), else the graph's."""

    def parametric(q):
        c = t.conversations.where("role = 'assistant' AND trim(text) <> ''").groupBy(F.col("conv_id").alias("qid")).agg(F.max_by(F.trim("text"), "turn").alias("answer"))
        return c.join(q.select("qid", "query"), "qid").withColumn("shared", F.size(F.array_intersect(terms(F.col("answer")), terms(F.col("query")))))

    return A.ask_in_turn(questions(t), [A.Stage("parametric", parametric, F.col("shared") >= 8), A.Stage("graph", graph_answers(t), F.lit(True), "at")])


def _reports(t: Tables):
    """What the table is filled from: a sentence for each nation, year and metric."""
    o = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    g = o.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.count("*").cast("decimal(28,6)").alias("orders"), F.round(F.sum("o_totalprice"), 2).cast("decimal(28,6)").alias("revenue"))
    g = g.unpivot(["n_name", "year"], ["orders", "revenue"], "metric", "value")
    text = F.concat_ws(" ", F.lit("In"), F.col("year").cast("string"), F.lit("the"), "metric", F.lit("of"), "n_name", F.lit("came to"), F.col("value").cast("string"))
    return g.select(F.xxhash64("n_name", "year", "metric").alias("id"), text.alias("text"))


@query("r16_table_by_search", """WITH n AS (SELECT n_name AS entity, n_regionkey FROM nation), p AS (SELECT unnest(['1991', '1994', '1995', '1996', '1997']) AS time),
  a AS (SELECT n_name AS entity, year(o_orderdate)::VARCHAR AS time, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
  g AS (SELECT n.entity, p.time, orders::DECIMAL(28,6) AS orders, revenue::DECIMAL(28,6) AS revenue FROM n CROSS JOIN p LEFT JOIN a ON a.entity = n.entity AND a.time = p.time)
  SELECT entity, time, orders, revenue FROM g UNION ALL SELECT 'every nation', time, sum(orders)::DECIMAL(28,6), sum(revenue)::DECIMAL(28,6) FROM g GROUP BY time""")
def _(t: Tables):
    """Grid, search of reports for each cell, answers read from hits, pivot, typed load; a guarded statement over the new table adds totals."""
    spark, docs = t.spark, _reports(t)
    index = TextIndex(spark, fresh(t, "reports"), 16, lambda text: F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)))
    index.insert(docs, id_col="id")
    periods = spark.createDataFrame(list(enumerate(("1991", "1994", "1995", "1996", "1997"))), "pos long, time string")
    metrics = spark.createDataFrame([(0, "orders"), (1, "revenue")], "pos long, metric string")
    grid = T.task_grid(t.nation.select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("entity")), periods, metrics)
    words = F.concat_ws(" ", "metric", "entity", "time")
    about = F.concat_ws(" ", F.lit("In"), "time", F.lit("the"), "metric", F.lit("of"), "entity", F.lit("came to "))
    read = F.when(F.startswith("text", about), F.substring_index("text", "came to ", -1)).otherwise("未找到")
    table = A.filled_table(index, docs, grid, words, read, ["orders", "revenue"])
    totals = T.guarded_sql(spark, "SELECT 'every nation' AS entity, time, CAST(sum(orders) AS DECIMAL(28,6)) AS orders, CAST(sum(revenue) AS DECIMAL(28,6)) AS revenue FROM {table} GROUP BY time", table=table)
    return table.unionByName(totals)
