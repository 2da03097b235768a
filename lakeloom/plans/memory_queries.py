"""Queries of fact memory, history, generated tables, events and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.vectors import cosine
from lakeloom.operators import memory as M
from lakeloom.operators import tables as B
from lakeloom.plans import fixtures as X
from lakeloom.plans.registry import Tables, query
from lakeloom.session import shared_dir
from lakeloom.sources.keyed import KeyedTable
from lakeloom.streaming import history as H

_COS = "(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))"


@query("p1_scope_filter", "SELECT event_id FROM events WHERE user_id = 7 AND event_type = 'click'")
def _(t: Tables):
    return t.events.where(M.scope_filter(M.build_scope(user_id=7, filters={"event_type": "click"}))).select("event_id")


@query("p5_promoted_keys", "SELECT event_id, user_id::VARCHAR AS user_id, 1 AS rest FROM events")
def _(t: Tables):
    m = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("data"), F.lit("x"), F.lit("extra"), F.col("event_type"))
    cols = {c: x for c, x in zip((*M.PROMOTED, "metadata"), M.split_metadata(F.col("m")), strict=True)}
    return t.events.select("event_id", m.alias("m")).select("event_id", cols["user_id"], F.size(cols["metadata"]).alias("rest"))


@query("p9_lookup_status", "SELECT vec_id, CASE WHEN doc_id IS NULL THEN 'not_found' ELSE 'found' END AS status FROM embeddings LEFT JOIN labels ON doc_id = vec_id")
def _(t: Tables):
    l = t.labels.select(F.col("doc_id").alias("vec_id"), F.lit("found").alias("s"))
    return t.embeddings.select("vec_id").join(l, "vec_id", "left").select("vec_id", F.coalesce("s", F.lit("not_found")).alias("status"))


@query("r12_fact_search", f"SELECT * FROM (SELECT a.vec_id AS id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 3 AND a.label = 1 ORDER BY score DESC, id LIMIT 20) WHERE score >= 0.05")
def _(t: Tables):
    f = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("user_id"))
    return M.search(f, X.query_vector(t, 3), M.build_scope(user_id=1), 20, 0.05)


@query("r13_inferred_ingest", f"""WITH s AS (SELECT a.vec_id AS f, b.vec_id AS m, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id WHERE a.vec_id % 100 = 0),
  x AS (SELECT f, max(score) AS score, arg_max(m, score) AS m FROM s GROUP BY f)
  SELECT vec_id AS fact_id, CASE WHEN score >= 0.999 THEN 'NONE' WHEN score >= 0.3 THEN 'UPDATE' ELSE 'ADD' END AS event, CASE WHEN score >= 0.3 THEN m END AS memory_id FROM embeddings LEFT JOIN x ON f = vec_id WHERE vec_id % 100 = 0""")
def _(t: Tables):
    new = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("fact_id"), F.col("embedding").alias("q"), "label")
    s = new.join(t.embeddings, "label").where("vec_id < fact_id").select("fact_id", F.col("vec_id").alias("memory_id"), F.round(cosine("q", "embedding"), 6).alias("score"))
    return M.decide(new.select("fact_id"), s, near=0.3)


@query("r14_raw_facts", "SELECT conv_id || '-' || turn AS id, text AS data, md5(text) AS hash, role FROM conversations WHERE role <> 'system' AND text IS NOT NULL")
def _(t: Tables):
    return M.raw_facts(t.conversations)


@query("x1_current_state", f"WITH {X.HISTORY} SELECT memory_id, id, event, new_memory FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY created_at DESC, id DESC) AS rn FROM history) WHERE rn = 1 AND event <> 'DELETE'")
def _(t: Tables):
    return M.current_state(X.history(t)).select("memory_id", "id", "event", "new_memory")


@query("w10_history_order", f"WITH {X.HISTORY} SELECT id, created_at FROM history WHERE memory_id = 5 ORDER BY created_at, id")
def _(t: Tables):
    return X.history(t).where("memory_id = 5").select("id", "created_at").orderBy("created_at", "id")


@query("w7_last_messages", "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def _(t: Tables):
    return M.last_messages(t.conversations, 3).select("conv_id", "turn", "text")


@query("w8_paired_turns", """WITH p AS (SELECT *, row_number() OVER w - 1 AS i, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS rn FROM p WHERE i % 2 = 0 AND nr IS NOT NULL AND ((role = 'user' AND nr = 'assistant') OR (role = 'assistant' AND nr = 'user')))
  SELECT conv_id, (i // 2) AS pair, CASE WHEN role = 'user' THEN text ELSE nt END AS user_text, CASE WHEN role = 'user' THEN nt ELSE text END AS assistant_text FROM q WHERE rn <= 3""")
def _(t: Tables):
    return M.paired_turns(t.conversations)


@query("w9_fill_down", "SELECT event_id, user_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS kind FROM events")
def _(t: Tables):
    e = t.events.select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("").alias("kind"))
    return B.fill_down(e, "event_id", ["kind"], ["user_id"])


_GRID = """e AS (SELECT n_nationkey AS pe, n_name AS entity FROM nation), p AS (SELECT * FROM (VALUES (0, '1995'), (1, '1996'), (2, '1997')) v(pt, time)), m AS (SELECT * FROM (VALUES (0, 'orders'), (1, 'revenue')) v(pm, metric)),
  grid AS (SELECT (pe * 3 + pt) * 2 + pm AS task_id, entity, time, metric FROM e, p, m),
  o AS (SELECT n_name AS entity, year(o_orderdate)::VARCHAR AS time, count(*) AS n, sum(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
  ans AS (SELECT entity, time, 'orders' AS metric, n::VARCHAR AS answer FROM o UNION ALL SELECT entity, time, 'revenue', round(s)::BIGINT::VARCHAR FROM o)"""


def _grid(t: Tables):
    e = t.nation.select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("entity"))
    p = t.spark.createDataFrame([(0, "1995"), (1, "1996"), (2, "1997")], "pos int, time string")
    m = t.spark.createDataFrame([(0, "orders"), (1, "revenue")], "pos int, metric string")
    return B.task_grid(e, p, m)


def _answers(t: Tables):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    o = o.groupBy(F.col("n_name").alias("entity"), F.year("o_orderdate").cast("string").alias("time")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    pairs = F.explode(F.array(F.struct(F.lit("orders").alias("metric"), F.col("n").cast("string").alias("answer")), F.struct(F.lit("revenue").alias("metric"), F.round("s").cast("long").cast("string").alias("answer"))))
    return o.select("entity", "time", pairs.alias("x")).select("entity", "time", "x.metric", "x.answer")


@query("j17_task_grid", f"WITH {_GRID} SELECT * FROM grid")
def _(t: Tables):
    return _grid(t)


@query("j16_answer_lookup", f"WITH {_GRID} SELECT task_id, entity, time, metric, coalesce(answer, '') AS answer FROM grid LEFT JOIN ans USING (entity, time, metric)")
def _(t: Tables):
    return B.fill_answers(_grid(t), _answers(t))


@query("g10_pivot", f"WITH {_GRID} SELECT entity, time, coalesce(max(answer) FILTER (metric = 'orders'), '') AS orders, coalesce(max(answer) FILTER (metric = 'revenue'), '') AS revenue FROM grid LEFT JOIN ans USING (entity, time, metric) GROUP BY 1, 2")
def _(t: Tables):
    return B.pivot_answers(B.fill_answers(_grid(t), _answers(t)), ["orders", "revenue"])


@query("s13_typed_table", f"WITH {_GRID} SELECT entity, orders::DECIMAL(28,6)::DOUBLE AS orders FROM (SELECT entity, time, max(answer) FILTER (metric = 'orders') AS orders FROM grid LEFT JOIN ans USING (entity, time, metric) GROUP BY 1, 2) WHERE time = '1996'")
def _(t: Tables):
    wide = B.pivot_answers(B.fill_answers(_grid(t), _answers(t)), ["orders", "revenue"])
    return B.typed_table(wide, ["orders"]).where("time = '1996'").select("entity", F.col("orders").cast("double").alias("orders"))


@query("r15_guarded_sql", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1 HAVING count(*) > 10")
def _(t: Tables):
    return B.guarded_sql(t.spark, "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM {customer} GROUP BY 1 HAVING count(*) > 10", customer=t.customer)


@query("a20_adhoc_aggregates", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, min(l_shipdate) AS first, max(l_shipdate) AS last, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t: Tables):
    return B.guarded_sql(t.spark, "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, min(l_shipdate) AS first, max(l_shipdate) AS last, count(*) AS n FROM {l} GROUP BY l_returnflag, l_linestatus", l=t.lineitem)


@query("a23_field_samples", "SELECT 'c_mktsegment' AS field, c_mktsegment AS v FROM (SELECT DISTINCT c_mktsegment FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5))")
def _(t: Tables):
    five = t.customer.orderBy("c_custkey").limit(5)
    return five.select(F.lit("c_mktsegment").alias("field"), F.col("c_mktsegment").alias("v")).distinct()


@query("structural_revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY n_name")
def _(t: Tables):
    o = t.orders.where("o_orderdate >= DATE'1996-01-01' AND o_orderdate < DATE'1997-01-01'")
    j = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("x8_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t: Tables):
    return H.event_windows(t.events)


@query("x8_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def _(t: Tables):
    return H.sessions(t.events)


@query("j21_asof_join", """SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'click' AND p.ts < e.ts AND p.ts = (SELECT max(q.ts) FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'click' AND q.ts < e.ts)) AS last_click FROM events e WHERE e.event_type = 'purchase'""")
def _(t: Tables):
    click = F.when(F.col("event_type") == "click", F.struct("ts", "event_id"))
    w = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(W.unboundedPreceding, -1)
    e = t.events.withColumn("c", F.max(click).over(w))
    return e.where("event_type = 'purchase'").select("event_id", F.col("c.event_id").alias("last_click"))


@query("x1_streamed_state", f"WITH {X.HISTORY} SELECT memory_id, id, event FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY created_at DESC, id DESC) AS rn FROM history WHERE memory_id IS NOT NULL) WHERE rn = 1 AND event <> 'DELETE'")
def _(t: Tables):
    base = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    h = X.history(t)
    h.repartitionByRange(3, "created_at").write.parquet(f"{base}/in")
    state = H.fold_history_by_key(t.spark, f"{base}/in", "id long, memory_id long, event string, new_memory string, created_at timestamp", f"{base}/checkpoint", f"{base}/state", 16)
    return state.select("memory_id", "id", "event")


@query("x2_short_term_buffers", "SELECT conv_id, least(count(*), 4) AS n, arg_max(text, turn) AS last_text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL GROUP BY conv_id")
def _(t: Tables):
    """Buffers of four messages in the state of a stream over three files; the last row of each conversation is kept by key."""
    base = f"{shared_dir(t.spark)}/buffers-{uuid.uuid4().hex}"
    c = t.conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    c.repartitionByRange(3, "turn").write.parquet(f"{base}/in")
    table = KeyedTable(t.spark, f"{base}/buffers", "conv_id long, n long, last_text string", ["conv_id"], 16)
    stream = H.short_term(H.file_stream(t.spark, f"{base}/in", "conv_id long, turn long, text string", 1), 4)
    H.run_available(stream, f"{base}/checkpoint", lambda b, number: table.replace(b.withColumn("gone", F.lit(False)), str(number)), "update")
    return table.read()


@query("x4_directory_scan", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 2 ELSE 1 END AS scan, 1 AS times FROM documents")
def _(t: Tables):
    """A folder scanned three times: uploads before the first and the second scan, none before the third; no file counts twice."""
    base = f"{shared_dir(t.spark)}/scan-{uuid.uuid4().hex}"
    for scan, uploads in enumerate(([0, 1], [2], []), 1):
        for k in uploads:
            t.documents.where(F.col("doc_id") % 3 == k).select("doc_id").write.mode("append").parquet(f"{base}/in")
        found = lambda b, n, s=scan: b.select("doc_id", F.lit(s).alias("scan")).write.mode("overwrite").parquet(f"{base}/out/scan={s}/batch={n}")
        H.run_available(H.file_stream(t.spark, f"{base}/in", "doc_id long"), f"{base}/checkpoint", found)
    rows = t.spark.read.schema("doc_id long, scan int").option("recursiveFileLookup", True).parquet(f"{base}/out")
    return rows.groupBy("doc_id", "scan").agg(F.count("*").cast("int").alias("times"))
