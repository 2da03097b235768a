"""Graph-memory retrieval for many queries at once: naive, local, global, hybrid and mix contexts.

Every list is a table (qid, id, pos); every step joins or windows by qid, so the number of queries
and the size of the memory only change how many rows a step has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.vectors import cosine
from lakeloom.operators.blocks import cosines
from lakeloom.operators.graph import degrees
from lakeloom.operators.modes import interleaved, mode_for, rerank
from lakeloom.operators.retrieval import token_budget
from lakeloom.session import materialize


@dataclass
class Memory:
    """entities(name, tokens, source_ids, v), relations(a, b, weight, tokens, source_ids, v), a <= b once a pair, chunks(chunk_id, tokens, v)."""

    entities: DataFrame
    relations: DataFrame
    chunks: DataFrame


@dataclass
class Limits:
    """Hits of each vector search and their least cosine; tokens of the sections and of the whole; chunks at the end; chunks a group may give."""

    top_k: int = 40
    least: float = 0.2
    entity_tokens: int = 10_000
    relation_tokens: int = 10_000
    total_tokens: int = 32_000
    overhead: int = 100
    chunk_top_k: int = 10
    related: int = 5


def _number(rows: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy("qid").orderBy(*order)))


def nearest(queries: DataFrame, items: DataFrame, k: int, least: float) -> DataFrame:
    """(qid, id, pos): for queries(qid, v) the k items(id, v) of largest cosine, least or more; ties by id.

    The stated queries against all items, block by block; each pair of blocks keeps what may be among the k best.
    """
    both = cosines(queries.select(F.col("qid").alias("id"), "v"), items.select("id", "v"), k, least)
    s = both.select(F.col("a").alias("qid"), F.col("b").alias("id"), F.round("cos", 6).alias("score")).where(F.col("score") >= least)
    return _number(s, F.desc("score"), "id").where(F.col("pos") <= k).select("qid", "id", "pos")


def _pairs(relations: DataFrame) -> DataFrame:
    return relations.select(F.struct("a", "b").alias("id"), "*")


def edges_of(hits: DataFrame, memory: Memory, most: int) -> DataFrame:
    """(qid, id, pos): the relations of entity hits, by their ends' degrees together, then weight; the first ``most``."""
    deg = degrees(memory.relations.select(F.col("a").alias("node1"), F.col("b").alias("node2")))
    ends = memory.relations.select("a", "b", "weight", F.explode(F.array("a", "b")).alias("name"))
    met = ends.join(hits.select("qid", F.col("id").alias("name")), "name").select("qid", "a", "b", "weight").distinct()
    for end in ("a", "b"):
        met = met.join(deg.select(F.col("node").alias(end), F.col("degree").alias(f"d{end}")), end)
    ranked = _number(met, F.desc(F.col("da") + F.col("db")), F.desc("weight"), "a", "b").where(F.col("pos") <= most)
    return ranked.select("qid", F.struct("a", "b").alias("id"), "pos")


def ends_of(hits: DataFrame) -> DataFrame:
    """(qid, id, pos): the ends of relation hits in the order in which they are met."""
    met = hits.select("qid", "pos", F.posexplode(F.array("id.a", "id.b")).alias("side", "end"))
    first = met.groupBy("qid", F.col("end").alias("id")).agg(F.min(F.struct("pos", "side")).alias("at"))
    return _number(first, "at").select("qid", "id", "pos")


def _mixed(*lists: DataFrame) -> DataFrame:
    every = None
    for n, one in enumerate(lists):
        part = one.select("qid", F.lit(n).alias("list_no"), F.col("pos").alias("rank"), "id")
        every = part if every is None else every.unionByName(part)
    return interleaved(every)


def polled_chunks(groups: DataFrame, most: int, least: int = 1) -> DataFrame:
    """(qid, id, pos): chunks of groups(qid, pos, source_ids array), each query's in its own weighted polling.

    A chunk belongs to the first group that names it; in a group those come first that most groups
    name, then in the group's order. The first group may give ``most`` chunks, the last ``least``,
    those between in a straight line; what a group leaves unused goes one by one to the earliest
    that have more.
    """
    dense = _number(groups.where(F.size("source_ids") > 0), "pos", name="grp").withColumn("grp", F.col("grp") - 1)
    dense = dense.withColumn("n", F.count("*").over(W.partitionBy("qid")))
    line = F.when(F.col("n") < 2, F.lit(float(most))).otherwise(F.lit(float(most)) - F.col("grp") / (F.col("n") - 1) * F.lit(most - least))
    dense = dense.withColumn("quota", F.bround(line, 0).cast("long"))
    named = dense.select("qid", "grp", "quota", F.posexplode("source_ids").alias("at", "id"))
    counts = named.groupBy("qid", "id").agg(F.count("*").alias("times"), F.min(F.struct("grp", "at", "quota")).alias("first"))
    own = counts.select("qid", "id", "times", "first.grp", "first.at", "first.quota")
    own = own.withColumn("rn", F.row_number().over(W.partitionBy("qid", "grp").orderBy(F.desc("times"), "at")))
    used = own.groupBy("qid", "grp").agg(F.least(F.max("rn"), F.first("quota")).alias("used")).groupBy("qid").agg(F.sum("used").alias("used"))
    spare = dense.groupBy("qid").agg(F.sum("quota").alias("all")).join(used, "qid").select("qid", (F.col("all") - F.col("used")).alias("spare"))
    over = F.col("rn") > F.col("quota")
    turn = F.row_number().over(W.partitionBy("qid", over).orderBy("grp", "rn"))
    taken = own.withColumn("turn", turn).join(spare, "qid").where(~over | (F.col("turn") <= F.col("spare")))
    return _number(taken, over, "grp", "rn").select("qid", "id", "pos")


def without_chunks(groups: DataFrame, taken: DataFrame) -> DataFrame:
    """groups(qid, pos, source_ids array) without the chunks in taken(qid, id); those left with none go."""
    left = groups.select("qid", F.col("pos").alias("_p"), F.posexplode("source_ids").alias("at", "id")).join(taken.select("qid", "id").distinct(), ["qid", "id"], "left_anti")
    return left.groupBy("qid", F.col("_p").alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("source_ids"))


def nearest_chunks(groups: DataFrame, queries: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """(qid, id, pos): of the chunks that a query's groups(qid, source_ids) name, the ``most`` of largest cosine of chunks(chunk_id, v) to queries(qid, v).

    Each chunk counts once; one without a vector is left out. Ties go by id.
    """
    named = groups.select("qid", F.explode("source_ids").alias("id")).distinct()
    s = named.join(queries.select("qid", "v"), "qid").join(chunks.select(F.col("chunk_id").alias("id"), F.col("v").alias("w")), "id")
    s = s.select("qid", "id", F.round(cosine("v", "w"), 6).alias("score")).where("score IS NOT NULL")
    return _number(s, F.desc("score"), "id").where(F.col("pos") <= most).select("qid", "id", "pos")


def contexts(queries: DataFrame, memory: Memory, limits: Limits, score: Column | None = None) -> DataFrame:
    """(qid, section, pos, id, tokens): the entity, relation and chunk sections of each query's context.

    queries(qid, mode, v, low, high): v is the query's vector, low and high those of its keywords
    on entities and on relations. Modes local, global, hybrid and mix that lack one of the two go
    over to the other's, and have no context without both; naive needs v alone. Entities and
    relations are cut by their own budgets, chunks by what the whole leaves; score is an expression
    on chunk rows (qid, id, rank, tokens) that reranks them, none keeps their order. An id of a
    relation is 'a|b'. A query that finds no entity and no relation has no context, unless naive.
    """
    q = queries.withColumn("known", mode_for(F.when(F.col("low").isNotNull(), "x"), F.when(F.col("high").isNotNull(), "x")))
    graph = F.col("mode") != "naive"
    mode = F.when(~graph, F.col("mode")).when((F.col("known") == "hybrid") | (F.col("known") == F.col("mode")), F.col("mode"))
    q = q.withColumn("mode", F.coalesce(mode, F.when(F.col("mode").isin("hybrid", "mix"), F.col("known")), F.lit("fail")))
    q = materialize(q.select("qid", "mode", "v", "low", "high"), "memory-queries")
    entities, relations = memory.entities, _pairs(memory.relations)

    local = q.where("mode IN ('local', 'hybrid', 'mix')").select("qid", F.col("low").alias("v"))
    near = materialize(nearest(local, entities.select(F.col("name").alias("id"), "v"), limits.top_k, limits.least), "memory-entities")
    overall = q.where("mode IN ('global', 'hybrid', 'mix')").select("qid", F.col("high").alias("v"))
    wide = materialize(nearest(overall, relations, limits.top_k, limits.least), "memory-relations")

    known = entities.select(F.col("name").alias("id"), "tokens", "source_ids")
    found = _mixed(near, ends_of(wide)).join(known, "id")
    kept = materialize(token_budget(found, limits.entity_tokens, group=["qid"]), "memory-entity-section")
    found = _mixed(edges_of(near, memory, limits.relation_tokens), wide).join(relations.select("id", "tokens", "source_ids"), "id")
    paths = materialize(token_budget(found, limits.relation_tokens, group=["qid"]), "memory-relation-section")

    stored = memory.chunks.select(F.col("chunk_id").alias("id"), "tokens")
    of_entities = _number(polled_chunks(kept, limits.related).withColumnRenamed("pos", "_p").join(stored, "id", "left_semi"), "_p").select("qid", "id", "pos")
    of_entities = materialize(of_entities, "memory-entity-chunks")
    others = without_chunks(paths, of_entities)
    of_relations = _number(polled_chunks(others, limits.related).withColumnRenamed("pos", "_p").join(stored, "id", "left_semi"), "_p").select("qid", "id", "pos")
    direct = nearest(q.where("mode IN ('mix', 'naive')").select("qid", "v"), memory.chunks.select(F.col("chunk_id").alias("id"), "v"), limits.chunk_top_k, limits.least)

    tokens = lambda df: df.select("qid", "tokens")
    spent = tokens(kept).unionByName(tokens(paths)).groupBy("qid").agg(F.sum("tokens").alias("spent"))
    some = q.join(spent, "qid", "left").where("mode = 'naive' OR spent IS NOT NULL").select("qid", (F.lit(limits.total_tokens - limits.overhead) - F.coalesce("spent", F.lit(0))).alias("room"))
    chunks = _mixed(direct, of_entities, of_relations).withColumnRenamed("pos", "rank").join(stored, "id").join(some, "qid")
    chunks = rerank(chunks, score, limits.chunk_top_k)
    chunks = chunks.withColumn("_sum", F.sum("tokens").over(W.partitionBy("qid").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))).where("_sum <= room")

    part = lambda df, name, i: df.select("qid", F.lit(name).alias("section"), F.col("pos").cast("int"), i.cast("string").alias("id"), F.col("tokens").cast("long"))
    out = part(kept, "entity", F.col("id")).unionByName(part(paths, "relation", F.concat_ws("|", "id.a", "id.b"))).unionByName(part(chunks, "chunk", F.col("id")))
    return out.withColumn("pos", F.row_number().over(W.partitionBy("qid", "section").orderBy("pos")))
