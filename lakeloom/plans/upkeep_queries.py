"""Queries of the document queue and of wikis under edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import upkeep as K
from lakeloom.operators.retrieval import vector_top_k_batch
from lakeloom.operators.wiki import Wiki, lint
from lakeloom.plans.registry import Tables, query
from lakeloom.plans.store_queries import fresh
from lakeloom.session import materialize
from lakeloom.sources.writers import wipe_dataset
from lakeloom.streaming.queue import DocumentQueue


def _process(rows):
    """Fails by a rule of document and attempt; every eleventh never succeeds, every thirteenth gives no row."""
    n = F.col("doc_id").cast("long")
    ok = ((n + F.col("attempts")) % 3 != 0) & (n % 11 != 0)
    return rows.where(n % 13 != 5).select("doc_id", ok.alias("ok"), F.when(~ok, F.concat(F.lit("attempt "), F.col("attempts").cast("string"))).alias("error"), F.length("text").alias("output"))


@query("x3_document_queue", """WITH a AS (SELECT doc_id, n_chars, text, unnest([1, 2, 3]) AS attempt FROM documents),
  r AS (SELECT *, (doc_id + attempt) % 3 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 5 AS ok FROM a),
  f AS (SELECT doc_id, any_value(text) AS text, coalesce(min(attempt) FILTER (WHERE ok), 3) AS attempts, bool_or(ok) AS ok FROM r GROUP BY doc_id)
  SELECT doc_id::VARCHAR AS doc_id, CASE WHEN ok THEN 'PROCESSED' ELSE 'FAILED' END AS status, attempts::INTEGER AS attempts,
    CASE WHEN ok THEN NULL WHEN doc_id % 13 = 5 THEN 'failed' ELSE 'attempt 3' END AS error, CASE WHEN ok THEN length(text)::VARCHAR END AS output FROM f""")
def _(t: Tables):
    """Documents in three files, found by a directory scan (the last one while the queue is drained), tried up to three times."""
    folder, queue = fresh(t, "arrivals"), DocumentQueue(t.spark, fresh(t, "queue"), 8)
    docs = materialize(t.documents.select("doc_id", "text"), "queue-documents")
    late = [2, 1]

    def arrive() -> None:
        if late:
            k = late.pop()
            docs.where(F.col("doc_id") % 3 == k).write.mode("append").parquet(folder)
        queue.scan(folder, "doc_id long, text string", f"{folder}-checkpoint")

    docs.where("doc_id % 3 = 0").write.parquet(folder)
    queue.drain(_process, now=0, arrivals=arrive)
    return queue.status.read().select("doc_id", "status", "attempts", "error").join(queue.outputs(), "doc_id", "left")


def _wiki(t: Tables) -> tuple:
    """A page for each document, with links by number, and the edits on them."""
    n = F.col("doc_id")
    name = lambda k: F.concat(F.lit("Doc "), k.cast("string"))
    content = F.concat(F.lit("---\ntitle: "), name(n), F.lit("\n---\n"), F.coalesce("text", F.lit("")), F.lit("\n[["), name(n * 3 % 1009), F.lit("]]"))
    pages = t.documents.select(F.concat(F.lit("pages/Doc-"), n.cast("string"), F.lit(".md")).alias("path"), content.alias("content"))
    d = t.documents.select(n.alias("n"), F.concat(F.lit("pages/Doc-"), n.cast("string"), F.lit(".md")).alias("path"), F.substring("text", 1, 12).alias("first"))
    kind = F.when(F.col("n") % 5 == 1, "delete").when(F.col("n") % 5 == 2, "create").otherwise("edit")
    fresh_page = F.when(F.col("n") % 2 == 0, F.concat(F.lit("---\ntitle: New "), F.col("n").cast("string"), F.lit("\n---\ntext"))).otherwise(F.lit("text"))
    edits = d.select((F.col("n") * 2).alias("seq"), kind.alias("op"), "path", F.when(kind == "edit", F.col("first")).alias("old"), F.when(kind == "edit", "<1>").when(kind == "create", fresh_page).alias("new"))
    more = d.where("n % 10 IN (0, 1)").select((F.col("n") * 2 + 1).alias("seq"), F.lit("edit").alias("op"), "path", F.lit("<1>").alias("old"), F.lit("<2>").alias("new"))
    wiki = Wiki(t.spark, fresh(t, "wiki"))
    wiki.table.replace(pages.withColumn("gone", F.lit(False)))
    return wiki, edits.unionByName(more)


_WIKI = """d AS (SELECT doc_id AS n, 'pages/Doc-' || doc_id || '.md' AS path, substr(text, 1, 12) AS first,
    '---' || chr(10) || 'title: Doc ' || doc_id || chr(10) || '---' || chr(10) || coalesce(text, '') || chr(10) || '[[Doc ' || (doc_id * 3 % 1009) || ']]' AS content FROM documents),
  c AS (SELECT *, CASE WHEN length(first) > 0 THEN (length(content) - length(replace(content, first, ''))) // length(first) ELSE 0 END AS k FROM d),
  a AS (SELECT *, CASE WHEN n % 5 = 1 THEN NULL WHEN n % 5 <> 2 AND k = 1 THEN substr(content, 1, instr(content, first) - 1) || '<1>' || substr(content, instr(content, first) + length(first)) ELSE content END AS one FROM c),
  b AS (SELECT *, (length(one) - length(replace(one, '<1>', ''))) // 3 AS k2 FROM a),
  after AS (SELECT *, CASE WHEN n % 10 IN (0, 1) AND k2 = 1 THEN replace(one, '<1>', '<2>') ELSE one END AS two FROM b),
  made AS (SELECT 'pages/New-' || n || '.md' AS path, '---' || chr(10) || 'title: New ' || n || chr(10) || '---' || chr(10) || 'text' AS content, n FROM d WHERE n % 5 = 2 AND n % 2 = 0),
  pages_after AS (SELECT path, two AS content FROM after WHERE two IS NOT NULL UNION ALL SELECT path, content FROM made)"""


@query("m39_wiki_edits", f"""WITH {_WIKI} SELECT n * 2 AS seq, path, CASE WHEN n % 5 = 1 THEN 'ok: deleted' WHEN n % 5 = 2 THEN 'error: already exists' WHEN k = 0 THEN 'error: not found' WHEN k > 1 THEN 'error: matches ' || k ELSE 'ok: edited' END AS result
    FROM after WHERE NOT (n % 5 = 2 AND n % 2 = 0)
  UNION ALL SELECT n * 2, path, 'ok: created' FROM made
  UNION ALL SELECT n * 2 + 1, path, CASE WHEN one IS NULL THEN 'error: does not exist' WHEN k2 = 0 THEN 'error: not found' WHEN k2 > 1 THEN 'error: matches ' || k2 ELSE 'ok: edited' END FROM after WHERE n % 10 IN (0, 1)""")
def _(t: Tables):
    wiki, edits = _wiki(t)
    return wiki.work(edits).results()


@query("m40_wiki_promote", f"WITH {_WIKI} SELECT path, sha256(content) AS content FROM pages_after")
def _(t: Tables):
    """The wiki after a refused promotion (a check that finds something), an accepted one, one too many, and its rollback."""
    wiki, edits = _wiki(t)
    copy = wiki.work(edits)
    if wiki.promote(copy, check=lambda pages: pages.where("path LIKE 'pages/New%'")):
        raise AssertionError("the check found pages")
    wiki.promote(copy)
    kept = wiki.version()
    wiki.promote(wiki.work(t.documents.select(F.col("doc_id").alias("seq"), F.lit("delete").alias("op"), F.concat(F.lit("pages/Doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))))
    wiki.rollback(kept)
    return wiki.pages().select("path", F.sha2("content", 256).alias("content"))


@query("m40_wiki_lint", f"""WITH {_WIKI}, l AS (SELECT DISTINCT path, unnest(regexp_extract_all(content, '\\[\\[([^\\]]+)\\]\\]', 1)) AS link FROM pages_after),
  s AS (SELECT *, 'pages/' || replace(link, ' ', '-') || '.md' AS goal FROM l)
  SELECT 'dead link' AS kind, path, link AS target FROM s WHERE goal NOT IN (SELECT path FROM pages_after)
  UNION ALL SELECT 'orphan', path, NULL FROM pages_after WHERE path NOT IN (SELECT goal FROM s WHERE goal <> s.path)
  UNION ALL SELECT 'not in index', path, NULL FROM pages_after""")
def _(t: Tables):
    """The same edits, held in a working copy."""
    wiki, edits = _wiki(t)
    return lint(wiki.preview(wiki.work(edits)))


@query("m31_repair", "SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 4 = 1 THEN 'FAILED' ELSE 'PENDING' END AS status, doc_id % 2 = 0 AS has_content FROM documents WHERE doc_id % 2 = 0 OR doc_id % 4 = 1")
def _(t: Tables):
    """Half of the documents have lost their content; of these the failed ones keep their status."""
    queue = DocumentQueue(t.spark, fresh(t, "queue"), 8)
    d = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", (F.col("doc_id") % 4).alias("k"))
    none = F.lit(None).cast("string")
    status = d.select("doc_id", F.when(F.col("k") == 1, "FAILED").otherwise("PENDING").alias("status"), F.lit(1).alias("attempts"), F.lit(0).cast("long").alias("updated"), none.alias("error"), none.alias("round"), F.lit(False).alias("gone"))
    queue.status.replace(status)
    queue.content.replace(d.where("k IN (0, 2)").select("doc_id", "text", F.lit(False).alias("gone")))
    queue.repair()
    kept = queue.content.read().select("doc_id", F.lit(True).alias("c"))
    return queue.status.read().select("doc_id", "status").join(kept, "doc_id", "left").select("doc_id", "status", F.coalesce("c", F.lit(False)).alias("has_content"))


@query("m36_vector_deletes", """WITH v AS (SELECT 'ent-' || md5(c_name) AS vid, c_name AS name, NULL AS a, NULL AS b, c_custkey AS k FROM customer UNION ALL
  SELECT 'rel-' || CASE WHEN c_custkey % 2 = 0 THEN md5(c_name || n_name) ELSE md5(n_name || c_name) END, NULL, c_name, n_name, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey)
  SELECT vid FROM v WHERE k % 7 <> 3""")
def _(t: Tables):
    """Vectors of customers and of their relations to nations, some stored the other way round; those of every seventh customer go."""
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    even = F.col("c_custkey") % 2 == 0
    rel = F.concat(F.lit("rel-"), F.md5(F.when(even, F.concat("c_name", "n_name")).otherwise(F.concat("n_name", "c_name"))))
    vectors = t.customer.select(F.concat(F.lit("ent-"), F.md5("c_name")).alias("vid")).unionByName(c.select(rel.alias("vid")))
    gone = c.where("c_custkey % 7 = 3")
    return K.delete_vectors(vectors, gone.select(F.col("c_name").alias("name")), gone.select(F.col("n_name").alias("a"), F.col("c_name").alias("b")))


@query("m12_wipe", "SELECT 'shared' AS name, lang AS dataset, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY lang UNION ALL SELECT 'sheet', 'de', count(*) FROM documents WHERE lang = 'de'")
def _(t: Tables):
    """A shared table by dataset and a sheet for each of two datasets; one dataset is wiped."""
    folder = fresh(t, "datasets")
    d = t.documents.select("doc_id", F.col("lang").alias("dataset"))
    d.write.partitionBy("dataset").parquet(f"{folder}/shared")
    for lang in ("en", "de"):
        d.where(F.col("dataset") == lang).select("doc_id").write.parquet(f"{folder}/sheet.{lang}")
    if wipe_dataset(t.spark, folder, "en") != ["shared/dataset=en", "sheet.en"]:
        raise AssertionError("the dataset's tables were there")
    left = t.spark.read.parquet(f"{folder}/shared").groupBy("dataset").agg(F.count("*").alias("n")).select(F.lit("shared").alias("name"), "dataset", "n")
    return left.unionByName(t.spark.read.parquet(f"{folder}/sheet.de").agg(F.count("*").alias("n")).select(F.lit("sheet").alias("name"), F.lit("de").alias("dataset"), "n"))


@query("k12_custom_graph", """WITH c AS (SELECT o_orderkey AS s, 'chunk-' || md5(o_orderpriority || o_orderstatus || (o_orderkey % 50)) AS chunk_id FROM orders WHERE o_orderkey % 3 > 0),
  i AS (SELECT s, min(chunk_id) AS chunk_id FROM c GROUP BY s), e AS (SELECT c_name AS name, c_mktsegment AS type, 'customer ' || c_custkey AS description, c_custkey AS s FROM customer WHERE c_custkey % 4 > 0),
  r AS (SELECT c_name AS a, n_name AS b, 'lives in' || (c_custkey % 3) AS description, c_custkey AS s FROM customer JOIN nation ON n_nationkey = c_nationkey),
  x AS (SELECT name, description, coalesce(chunk_id, 'UNKNOWN') AS chunk_id FROM (SELECT unnest([a, b]) AS name, description, s FROM r) LEFT JOIN i USING (s) WHERE name NOT IN (SELECT name FROM e))
  SELECT name, type, description, coalesce(chunk_id, 'UNKNOWN') AS chunk_id FROM e LEFT JOIN i USING (s)
  UNION ALL SELECT name, 'UNKNOWN', description, chunk_id FROM x QUALIFY row_number() OVER (PARTITION BY name ORDER BY description, chunk_id) = 1""")
def _(t: Tables):
    chunks = t.orders.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("source_id"), F.concat("o_orderpriority", "o_orderstatus", (F.col("o_orderkey") % 50).cast("string")).alias("content"))
    entities = t.customer.where("c_custkey % 4 > 0").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("description"), F.col("c_custkey").alias("source_id"))
    r = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    relations = r.select(F.col("c_name").alias("a"), F.col("n_name").alias("b"), F.concat(F.lit("lives in"), (F.col("c_custkey") % 3).cast("string")).alias("description"), F.lit("k").alias("keywords"), F.lit(1.0).alias("weight"), F.col("c_custkey").alias("source_id"))
    return K.insert_custom(chunks, entities, relations)[1]


_ANSWER = "CASE b.label % 4 WHEN 0 THEN '未找到' WHEN 1 THEN (id % 90)::VARCHAR || ' million' WHEN 2 THEN ' about ' || id ELSE (id * 1000)::VARCHAR END"


@query("m21_best_answers", f"""WITH h AS (SELECT a.vec_id AS task_id, b.vec_id AS id, b.label, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
  b AS (SELECT * FROM h WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY score DESC, id) = 1),
  s AS (SELECT q.vec_id AS task_id, b.label, b.id, {_ANSWER} AS said FROM embeddings q LEFT JOIN b ON b.task_id = q.vec_id WHERE q.vec_id % 100 = 0)
  SELECT task_id, CASE WHEN id IS NULL OR said = '未找到' THEN '' ELSE trim(said, ' ') END AS answer, CASE WHEN id IS NULL THEN NULL WHEN label % 4 = 1 THEN id % 90 * 1e6 WHEN label % 4 = 3 THEN id * 1000.0::DOUBLE END AS number FROM s""")
def _(t: Tables):
    """The best of five hits of each task, with an answer that a model might have read from it."""
    q = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), "label")
    hits = vector_top_k_batch(t.embeddings, q, 6, "label").where("qid <> vec_id").join(t.embeddings.select("vec_id", "label"), "vec_id")
    n, kind = F.col("vec_id"), F.col("label") % 4
    answer = F.when(kind == 0, "未找到").when(kind == 1, F.concat((n % 90).cast("string"), F.lit(" million"))).when(kind == 2, F.concat(F.lit(" about "), n.cast("string"))).otherwise((n * 1000).cast("string"))
    return K.task_answers(q.select(F.col("qid").alias("task_id")), hits.select(F.col("qid").alias("task_id"), F.col("vec_id").alias("id"), "score", answer.alias("answer")), 0.2)
