"""Queries of multi-hop search with evidence and of model slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators.evidence import best_paths, citations
from lakeloom.operators.model_slots import Slot, rerank_pairs
from lakeloom.operators.retrieval import limit_ranks, vector_top_k_batch
from lakeloom.plans.registry import Tables, query

_COS = "(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))"
_NEAR = f"""near AS (SELECT a.vec_id AS qid, b.vec_id AS id, round({_COS}, 6) AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"""


def _near(t: Tables, k: int):
    q = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), "label")
    hits = vector_top_k_batch(t.embeddings, q, k + 1, "label").where("qid <> vec_id")
    return limit_ranks(hits.withColumnRenamed("vec_id", "id"), k)


def _edges(t: Tables):
    """Orders and customers both ways, customers to nations, nations to regions and both ways to suppliers."""
    o, c, n, s = t.orders, t.customer, t.nation, t.supplier
    edge = lambda df, name, key, a, src, b, dst, gain: df.select(
        F.concat(F.lit(name), F.col(key).cast("string")).alias("edge"), F.lit(a).alias("src_type"), F.col(src).cast("long").alias("src"), F.lit(b).alias("dst_type"), F.col(dst).cast("long").alias("dst"), gain.alias("gain")
    )
    worth = F.col("o_totalprice") / 1_000_000
    parts = [
        edge(o, "o", "o_orderkey", "order", "o_orderkey", "customer", "o_custkey", worth), edge(o, "O", "o_orderkey", "customer", "o_custkey", "order", "o_orderkey", worth),
        edge(c, "c", "c_custkey", "customer", "c_custkey", "nation", "c_nationkey", F.lit(0.5)), edge(s, "s", "s_suppkey", "nation", "s_nationkey", "supplier", "s_suppkey", F.lit(0.1)),
        edge(n, "n", "n_nationkey", "nation", "n_nationkey", "region", "n_regionkey", F.lit(0.25)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _evidence(t: Tables):
    """From orders numbered like each query's three nearest vectors, up to four hops, a query stopping once it knows two nations."""
    start = _near(t, 3).select("qid", F.lit("order").alias("type"), "id", "score")
    return best_paths(start, _edges(t), 4, enough=lambda found: found.where("type = 'nation'").groupBy("qid").count().where("count >= 2"))


def _hop(n: int) -> str:
    before = f"s{n - 1}"
    return f"""c{n} AS (SELECT p.qid, e.dst_type AS type, e.dst AS id, round(p.score + e.gain, 6) AS score, list_append(p.path, e.edge) AS path FROM {before} p JOIN e ON e.src_type = p.type AND e.src = p.id
    WHERE p.hop = {n - 1} AND p.qid NOT IN (SELECT qid FROM {before} WHERE type = 'nation' GROUP BY qid HAVING count(*) >= 2)),
  b{n} AS (SELECT qid, type, id, {n} AS hop, score, path FROM (SELECT *, row_number() OVER (PARTITION BY qid, type, id ORDER BY score DESC, path) AS rn FROM c{n}) c
    WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM {before} x WHERE x.qid = c.qid AND x.type = c.type AND x.id = c.id)),
  s{n} AS (SELECT * FROM {before} UNION ALL SELECT * FROM b{n})"""


_PATHS = f"""{_NEAR}, e AS (SELECT 'o' || o_orderkey AS edge, 'order' AS src_type, o_orderkey AS src, 'customer' AS dst_type, o_custkey AS dst, o_totalprice / 1000000 AS gain FROM orders
    UNION ALL SELECT 'O' || o_orderkey, 'customer', o_custkey, 'order', o_orderkey, o_totalprice / 1000000 FROM orders UNION ALL SELECT 'c' || c_custkey, 'customer', c_custkey, 'nation', c_nationkey, 0.5 FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'nation', s_nationkey, 'supplier', s_suppkey, 0.1 FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'nation', n_nationkey, 'region', n_regionkey, 0.25 FROM nation),
  s0 AS (SELECT qid, 'order' AS type, id, 0 AS hop, score, []::VARCHAR[] AS path FROM near WHERE rank <= 3), {", ".join(_hop(n) for n in range(1, 5))}"""


@query("r4_evidence_paths", f"WITH {_PATHS} SELECT qid, type, id, hop, score, array_to_string(path, '>') AS path FROM s4")
def _(t: Tables):
    return _evidence(t).select("qid", "type", "id", "hop", "score", F.array_join("path", ">").alias("path"))


@query("r4_citations", f"WITH {_PATHS}, u AS (SELECT DISTINCT qid, unnest(path) AS edge FROM s4) SELECT qid, c_mktsegment AS source, count(*) AS edges FROM u JOIN customer ON edge = 'c' || c_custkey GROUP BY ALL")
def _(t: Tables):
    return citations(_evidence(t), t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("edge"), F.col("c_mktsegment").alias("source")))


def _overlap():
    """A stand-in for a cross-encoder: the share of the query's distinct words that the text has."""

    def score(pairs):
        words = [(set(q.split()), set(t.split())) for q, t in pairs]
        return [round(len(q & t) / len(q), 6) if q else 0.0 for q, t in words]

    return score


def _shorter():
    return lambda pairs: [-float(len(t)) for _, t in pairs]


def _broken():
    def score(pairs):
        raise RuntimeError("no answer")

    return score


_WORDS = "list_filter(list_distinct(string_split_regex({0}, '\\s+')), lambda w: w <> '')"


@query("t8_model_rerank", f"""WITH {_NEAR}, h AS (SELECT near.*, coalesce(q.text, '') AS q, coalesce(d.text, '') AS t, CASE qid // 100 % 4 WHEN 0 THEN 'chunk' WHEN 1 THEN 'entity' WHEN 2 THEN 'relation' ELSE 'none' END AS mode
    FROM near JOIN documents d ON d.doc_id = near.id JOIN documents q ON q.doc_id = qid WHERE rank <= 12),
  w AS (SELECT *, {_WORDS.format("q")} AS a, {_WORDS.format("t")} AS b FROM h),
  m AS (SELECT *, CASE mode WHEN 'chunk' THEN CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b)) / len(a), 6) ELSE 0.0 END WHEN 'entity' THEN -length(t)::DOUBLE END AS ms FROM w)
  SELECT qid, id, pos, ms AS model_score, fell_back FROM (SELECT *, ms IS NULL AS fell_back, row_number() OVER (PARTITION BY qid ORDER BY -ms, rank, id) AS pos FROM m) WHERE pos <= 6""")
def _(t: Tables):
    """Twelve nearest of each query under four modes: a word model, one that prefers short texts, one that always fails, none."""
    text = t.documents.select("doc_id", "text")
    hits = _near(t, 12).join(text.withColumnRenamed("doc_id", "id"), "id").join(text.select(F.col("doc_id").alias("qid"), F.col("text").alias("query")), "qid")
    kind = F.floor(F.col("qid") / 100) % 4
    hits = hits.withColumn("mode", F.when(kind == 0, "chunk").when(kind == 1, "entity").when(kind == 2, "relation").otherwise("none"))
    return rerank_pairs(hits, {"chunk": Slot(_overlap), "entity": Slot(_shorter, max_rows=5), "relation": Slot(_broken, retries=1)}, 6)
