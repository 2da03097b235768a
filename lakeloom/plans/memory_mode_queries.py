"""The graph-memory modes over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators.memory_modes import Limits, Memory, contexts, nearest_chunks, polled_chunks, without_chunks
from lakeloom.plans.registry import Tables, query

LIMITS = Limits(top_k=8, least=0.15, entity_tokens=60, relation_tokens=70, total_tokens=2000, overhead=20, chunk_top_k=7, related=3)


def memory(t: Tables) -> Memory:
    """An entity for each vector, a relation from it to another one, documents as chunks that both name."""
    e = t.embeddings.select(F.col("vec_id").alias("k"), F.col("embedding").alias("v"))
    name = lambda k: F.concat(F.lit("e"), k.cast("string"))
    ids = lambda *ks: F.transform(F.array(*[k.cast("long") for k in ks]), lambda k: k.cast("string"))
    k, other = F.col("k"), F.col("k") * 7 % 31
    entities = e.select(name(k).alias("name"), (5 + k % 9).alias("tokens"), ids(k, k * 3, k % 10).alias("source_ids"), "v")
    r = e.where(k != other).select(F.least(name(k), name(other)).alias("a"), F.greatest(name(k), name(other)).alias("b"), k, (k % 5).cast("double").alias("weight"), (4 + k % 7).alias("tokens"), ids(k, k + 1, k % 4).alias("source_ids"), "v")
    r = r.groupBy("a", "b").agg(F.min_by(F.struct("weight", "tokens", "source_ids", "v"), "k").alias("r")).select("a", "b", "r.*")
    chunks = t.documents.select(F.col("doc_id").cast("string").alias("chunk_id"), (20 + F.col("n_chars") % 50).cast("long").alias("tokens"), F.col("doc_id").alias("k")).join(e, "k").drop("k")
    return Memory(entities, r, chunks)


def questions(t: Tables):
    e = t.embeddings.select("vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    for c, step in (("low", 1), ("high", 2)):
        q = q.join(e.select((F.col("vec_id") - step).alias("qid"), F.col("embedding").alias(c)), "qid", "left")
    n = F.floor(F.col("qid") / 20)
    mode = F.when(n % 5 == 0, "local").when(n % 5 == 1, "global").when(n % 5 == 2, "hybrid").when(n % 5 == 3, "mix").otherwise("naive")
    return q.select("qid", mode.alias("mode"), "v", F.when(n % 7 != 6, F.col("low")).alias("low"), F.when(n % 4 != 3, F.col("high")).alias("high"))


_COS = "round(list_inner_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_inner_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_inner_product({1}::DOUBLE[], {1}::DOUBLE[]))), 6)"


def _near(name: str, modes: str, vector: str, items: str, k: int) -> str:
    cos = _COS.format(f"q.{vector}", "i.v")
    return f"""{name} AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS pos FROM (SELECT q.qid, i.id, {cos} AS score FROM q, {items} i WHERE q.mode IN ({modes}) AND q.{vector} IS NOT NULL)
    WHERE score >= {LIMITS.least} QUALIFY pos <= {k})"""


def _mixed(name: str, *lists: str) -> str:
    union = " UNION ALL ".join(f"SELECT qid, {n} AS l, pos AS rank, id FROM {x}" for n, x in enumerate(lists))
    return f"{name} AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank, l, id) AS pos FROM (SELECT * FROM ({union}) QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY rank, l) = 1))"


def _polled(name: str, groups: str) -> str:
    most = LIMITS.related
    return f"""{name}_g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) - 1 AS grp, count(*) OVER (PARTITION BY qid) AS n FROM {groups} WHERE len(source_ids) > 0),
  {name}_q AS (SELECT *, CASE WHEN n < 2 THEN {most} ELSE round_even({most}.0::DOUBLE - grp / (n - 1) * {most - 1}, 0)::BIGINT END AS quota FROM {name}_g),
  {name}_n AS (SELECT qid, grp, quota, unnest(range(len(source_ids))) AS place, unnest(source_ids) AS id FROM {name}_q),
  {name}_o AS (SELECT *, row_number() OVER (PARTITION BY qid, grp ORDER BY times DESC, place) AS rn FROM (SELECT *, count(*) OVER (PARTITION BY qid, id) AS times FROM {name}_n QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY grp, place) = 1)),
  {name}_s AS (SELECT qid, (SELECT sum(quota) FROM {name}_q x WHERE x.qid = u.qid) - sum(used) AS spare FROM (SELECT qid, grp, least(max(rn), any_value(quota)) AS used FROM {name}_o GROUP BY ALL) u GROUP BY qid),
  {name}_t AS (SELECT *, row_number() OVER (PARTITION BY qid, rn > quota ORDER BY grp, rn) AS turn FROM {name}_o JOIN {name}_s USING (qid)),
  {name}_p AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rn > quota, grp, rn) AS p FROM {name}_t WHERE rn <= quota OR turn <= spare),
  {name} AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY p) AS pos FROM {name}_p WHERE id IN (SELECT id FROM chunk))"""


def _sql() -> str:
    return f"""WITH vec AS (SELECT vec_id AS k, embedding AS v FROM embeddings),
  ent AS (SELECT 'e' || k AS id, 5 + k % 9 AS tokens, [k::VARCHAR, (k * 3)::VARCHAR, (k % 10)::VARCHAR] AS source_ids, v FROM vec),
  rel AS (SELECT a || '|' || b AS id, a, b, (k % 5)::DOUBLE AS weight, 4 + k % 7 AS tokens, [k::VARCHAR, (k + 1)::VARCHAR, (k % 4)::VARCHAR] AS source_ids, v
    FROM (SELECT least('e' || k, 'e' || (k * 7 % 31)) AS a, greatest('e' || k, 'e' || (k * 7 % 31)) AS b, k, v FROM vec WHERE k <> k * 7 % 31 QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY k) = 1)),
  chunk AS (SELECT doc_id::VARCHAR AS id, 20 + n_chars % 50 AS tokens, v FROM documents JOIN vec ON k = doc_id),
  q0 AS (SELECT a.vec_id AS qid, a.vec_id // 20 AS n, a.embedding AS v, CASE WHEN a.vec_id // 20 % 7 <> 6 THEN b.embedding END AS low, CASE WHEN a.vec_id // 20 % 4 <> 3 THEN c.embedding END AS high
    FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 LEFT JOIN embeddings c ON c.vec_id = a.vec_id + 2 WHERE a.vec_id % 20 = 0),
  q1 AS (SELECT *, ['local', 'global', 'hybrid', 'mix', 'naive'][n % 5 + 1] AS m, CASE WHEN low IS NULL AND high IS NULL THEN 'fail' WHEN low IS NULL THEN 'global' WHEN high IS NULL THEN 'local' ELSE 'both' END AS have FROM q0),
  q AS (SELECT *, CASE WHEN m = 'naive' OR have = 'both' OR have = m THEN m WHEN m IN ('hybrid', 'mix') THEN have ELSE 'fail' END AS mode FROM q1),
  {_near("near", "'local', 'hybrid', 'mix'", "low", "ent", LIMITS.top_k)}, {_near("wide", "'global', 'hybrid', 'mix'", "high", "rel", LIMITS.top_k)},
  ends AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY pos, side) AS pos FROM (SELECT * FROM (SELECT qid, pos, 0 AS side, a AS id FROM wide JOIN rel USING (id) UNION ALL SELECT qid, pos, 1, b FROM wide JOIN rel USING (id))
    QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY pos, side) = 1)),
  deg AS (SELECT node, count(*) AS d FROM (SELECT a AS node FROM rel UNION ALL SELECT b FROM rel) GROUP BY node),
  hops AS (SELECT DISTINCT qid, r.id, a, b, weight FROM near JOIN rel r ON near.id IN (r.a, r.b)),
  edges AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY x.d + y.d DESC, weight DESC, a, b) AS pos FROM hops JOIN deg x ON x.node = a JOIN deg y ON y.node = b),
  {_mixed("ents", "near", "ends")}, {_mixed("rels", "edges", "wide")},
  kept AS (SELECT qid, id, pos, tokens, source_ids FROM ents JOIN ent USING (id) QUALIFY sum(tokens) OVER (PARTITION BY qid ORDER BY pos) <= {LIMITS.entity_tokens}),
  paths AS (SELECT qid, id, pos, tokens, source_ids FROM rels JOIN rel USING (id) QUALIFY sum(tokens) OVER (PARTITION BY qid ORDER BY pos) <= {LIMITS.relation_tokens}),
  {_polled("ce", "kept")},
  others AS (SELECT qid, pos, list_filter(source_ids, lambda s: NOT list_contains(coalesce(i, []), s)) AS source_ids FROM paths LEFT JOIN (SELECT qid, list(id) AS i FROM ce GROUP BY qid) USING (qid)),
  {_polled("cr", "others")}, {_near("direct", "'mix', 'naive'", "v", "chunk", LIMITS.chunk_top_k)}, {_mixed("all_chunks", "direct", "ce", "cr")},
  spent AS (SELECT qid, sum(tokens) AS spent FROM (SELECT qid, tokens FROM kept UNION ALL SELECT qid, tokens FROM paths) GROUP BY qid),
  room AS (SELECT qid, {LIMITS.total_tokens - LIMITS.overhead} - coalesce(spent, 0) AS room FROM q LEFT JOIN spent USING (qid) WHERE mode = 'naive' OR spent IS NOT NULL),
  top AS (SELECT qid, c.id, c.tokens, row_number() OVER (PARTITION BY qid ORDER BY pos, c.id) AS pos FROM all_chunks JOIN chunk c USING (id)  JOIN room USING (qid) QUALIFY pos <= {LIMITS.chunk_top_k}),
  last AS (SELECT qid, id, pos, tokens FROM top JOIN room USING (qid) QUALIFY sum(tokens) OVER (PARTITION BY qid ORDER BY pos) <= room)
  SELECT qid, section, (row_number() OVER (PARTITION BY qid, section ORDER BY pos))::INTEGER AS pos, id, tokens FROM (SELECT qid, 'entity' AS section, pos, id, tokens FROM kept
    UNION ALL SELECT qid, 'relation', pos, id, tokens FROM paths UNION ALL SELECT qid, 'chunk', pos, id, tokens FROM last)"""


@query("r6_r9_memory_contexts", _sql())
def _(t: Tables):
    return contexts(questions(t), memory(t), LIMITS)


_FOUND = f"""vec AS (SELECT vec_id AS k, embedding AS v FROM embeddings), chunk AS (SELECT doc_id::VARCHAR AS id, v FROM documents JOIN vec ON k = doc_id),
  rel AS (SELECT k // 10 AS qid, k % 10 + 1 AS pos, [(k // 3)::VARCHAR, (k // 3 + 7)::VARCHAR, (k % 40)::VARCHAR, (k // 10)::VARCHAR] AS source_ids FROM vec),
  taken AS (SELECT DISTINCT doc_id // 4 AS qid, doc_id::VARCHAR AS id FROM documents UNION SELECT doc_id % 50, (doc_id % 40)::VARCHAR FROM documents),
  open AS (SELECT qid, pos, list_filter(source_ids, lambda s: NOT list_contains(coalesce(i, []), s)) AS source_ids FROM rel LEFT JOIN (SELECT qid, list(id) AS i FROM taken GROUP BY qid) USING (qid))"""


@query("m29_polled_and_nearest", f"""WITH {_FOUND}, {_polled("way", "open")},
  near AS (SELECT u.qid, c.id, {_COS.format("q.v", "c.v")} AS score FROM (SELECT DISTINCT qid, unnest(source_ids) AS id FROM open) u JOIN chunk c USING (id) JOIN vec q ON q.k = u.qid)
  SELECT 'polled' AS method, qid, id, pos FROM way UNION ALL SELECT 'nearest', qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS pos FROM near QUALIFY pos <= 4""")
def _(t: Tables):
    """Chunks of relations that entities have not given yet: by weighted polling, and by nearness to the query."""
    e = t.embeddings.select(F.col("vec_id").alias("k"), F.col("embedding").alias("v"))
    k, text = F.col("k"), lambda c: F.floor(c).cast("long").cast("string")
    rel = e.select(F.floor(k / 10).alias("qid"), (k % 10 + 1).alias("pos"), F.array(text(k / 3), text(F.floor(k / 3) + 7), text(k % 40), text(k / 10)).alias("source_ids"))
    d = t.documents.select("doc_id")
    taken = d.select(F.floor(F.col("doc_id") / 4).alias("qid"), text(F.col("doc_id")).alias("id")).unionByName(d.select((F.col("doc_id") % 50).alias("qid"), text(F.col("doc_id") % 40).alias("id")))
    left = without_chunks(rel, taken)
    chunks = d.join(e.withColumnRenamed("k", "doc_id"), "doc_id").select(text(F.col("doc_id")).alias("chunk_id"), "v")
    polled = polled_chunks(left, LIMITS.related).join(chunks.select(F.col("chunk_id").alias("id")), "id", "left_semi")
    polled = polled.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy("pos")))
    near = nearest_chunks(left, e.withColumnRenamed("k", "qid"), chunks, 4)
    return polled.select(F.lit("polled").alias("method"), "qid", "id", "pos").unionByName(near.select(F.lit("nearest").alias("method"), "qid", "id", "pos"))
