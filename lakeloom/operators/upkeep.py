"""Upkeep of stored graphs, memories and trees: inserts that match by vector, merges, rebuilds, path trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.numbers import to_number
from lakeloom.operators.blocks import cosines
from lakeloom.operators.graph import merge_edges, merge_nodes, remap


def best_matches(new: DataFrame, stored: DataFrame, least: float, group: str) -> DataFrame:
    """(id, match, score): for new(id, v, group) the nearest of stored(match, w, group) with a cosine of least or more; ties by match."""
    both = cosines(new.select("id", "v", group), stored.select(F.col("match").alias("id"), F.col("w").alias("v"), group), 1, least, [group])
    scored = both.select(F.col("a").alias("id"), F.col("b").alias("match"), F.round("cos", 6).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "match")).alias("b"))
    return best.select("id", F.col("b.match").alias("match"), (-F.col("b.s")).alias("score"))


def insert_relations(nodes: DataFrame, edges: DataFrame, new: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, mentions) and edges (node1, relation, node2, mentions) after new(node1, relation, node2) came in.

    An endpoint that matches(id, match) knows is the matched node, any other is the node of its own
    name, there already or created. Each endpoint and each edge that is met counts one mention more.
    """
    m = matches.select(F.col("id").alias("name"), F.col("match").alias("canonical"))
    mapped = remap(new, m)
    met = mapped.select(F.explode(F.array("node1", "node2")).alias("node")).groupBy("node").agg(F.count("*").alias("more"))
    n = nodes.select("node", "mentions").join(met, "node", "full")
    added = mapped.groupBy("node1", "relation", "node2").agg(F.count("*").alias("more"))
    e = edges.select("node1", "relation", "node2", "mentions").join(added, ["node1", "relation", "node2"], "full")
    total = (F.coalesce("mentions", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("mentions")
    return n.select("node", total), e.select("node1", "relation", "node2", total)


def delete_relations(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges without those in gone(node1, relation, node2)."""
    return edges.join(gone, ["node1", "relation", "node2"], "left_anti")


def merge_graph(records: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both phases of a graph merge: entities by name, then edges by sorted pair; endpoints that no record names become UNKNOWN entities."""
    nodes, merged = merge_nodes(records), merge_edges(relations)
    ends = merged.select(F.explode(F.array("a", "b")).alias("name"), F.col("source_id")).groupBy("name").agg(F.min("source_id").alias("source_id"))
    unknown = ends.join(nodes, "name", "left_anti").select("name", F.lit("UNKNOWN").alias("type"), F.lit("").alias("description"), "source_id")
    return nodes.select("name", "type", "description", "source_id").unionByName(unknown), merged


def rebuild_entities(names: DataFrame, records: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, type, description): names(name) built anew from the records that survive.

    An entity without a record takes the distinct descriptions of its edges(node1, node2, description).
    """
    from_records = merge_nodes(records.join(names, "name", "left_semi")).select("name", "type", "description")
    lost = names.join(from_records, "name", "left_anti")
    ends = edges.select(F.explode(F.array("node1", "node2")).alias("name"), "description")
    from_edges = lost.join(ends, "name", "left").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("description")), "<SEP>").alias("description"))
    return from_records.unionByName(from_edges.select("name", F.lit("UNKNOWN").alias("type"), "description"))


def ordered_mappings(tables: list[DataFrame]) -> DataFrame:
    """(name, canonical): alias mappings of several rounds, the first table that knows a name deciding."""
    every = None
    for n, t in enumerate(tables):
        one = t.select("name", "canonical", F.lit(n).alias("n"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("name").agg(F.min(F.struct("n", "canonical"))["canonical"].alias("canonical"))


def absorb(pairs: DataFrame, k: int) -> DataFrame:
    """(main, absorbed): for each main chunk the ids of its k best candidates of pairs(main, other, score), best first."""
    rn = F.row_number().over(W.partitionBy("main").orderBy(F.desc("score"), "other"))
    best = pairs.withColumn("rn", rn).where(F.col("rn") <= k)
    return best.groupBy("main").agg(F.array_sort(F.collect_list(F.struct("rn", "other"))).alias("a")).select("main", F.transform("a", lambda x: x["other"]).alias("absorbed"))


def fold_batches(values: Column, size: int, merge, start: Column) -> Column:
    """A fold over batches of an array's values: merge(carried, batch) for each run of size values."""
    n = F.greatest(F.ceil(F.size(values) / size).cast("int"), F.lit(0))
    batches = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(values, i * size + 1, size)), lambda b: F.size(b) > 0)
    return F.aggregate(batches, start, merge)


def converged(before: int, after: int, ratio: float = 0.05) -> bool:
    """Whether a merge round removed so little that no other is due."""
    return before == 0 or (before - after) / before < ratio


def flatten_tree(nodes: DataFrame, max_depth: int = 8) -> DataFrame:
    """(id, depth, path) of nodes(id, parent, name): names from the root down; sorted by path it is preorder.

    A join a level, so the work is max_depth joins; deeper nodes and nodes that no root reaches are left out.
    """
    level = nodes.where("parent IS NULL").select("id", F.lit(0).alias("depth"), F.array("name").alias("path"))
    out = level
    for depth in range(1, max_depth + 1):
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("above"))
        level = nodes.join(up, "parent").select("id", F.lit(depth).alias("depth"), F.concat("above", F.array("name")).alias("path"))
        out = out.unionByName(level)
    return out


def assemble_tree(paths: DataFrame) -> DataFrame:
    """(path, children): for each path(array) the sorted names directly below it; the inverse of flatten_tree."""
    up = paths.where("size(path) > 1").select(F.expr("slice(path, 1, size(path) - 1)").alias("path"), F.element_at("path", -1).alias("child"))
    below = up.groupBy("path").agg(F.array_sort(F.collect_set("child")).alias("children"))
    return paths.select("path").join(below, "path", "left").select("path", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def caption_decisions(new: DataFrame, stored: DataFrame, group: str, same: float = 0.98, near: float = 0.8) -> DataFrame:
    """(id, event, match) for captions new(id, v, group): remain if the nearest stored one is the same, update if near, else add."""
    best = best_matches(new, stored, -1.0, group)
    d = new.select("id").join(best, "id", "left")
    event = F.when(F.col("score") >= same, "remain").when(F.col("score") >= near, "update").otherwise("add")
    return d.select("id", event.alias("event"), F.when(F.col("score") >= near, F.col("match")).alias("match"))


def newest(tasks: DataFrame, ts: str, key: str, max_age: str, most: int) -> DataFrame:
    """Tasks not older than max_age before the latest one, newest first, ``most`` of them."""
    last = tasks.agg(F.max(ts).alias("_last"))
    t = tasks.crossJoin(F.broadcast(last)).where(F.col(ts) >= F.col("_last") - F.expr(f"INTERVAL {max_age}")).drop("_last")  # one row
    return t.orderBy(F.desc(ts), F.desc(key)).limit(most)


def delete_vectors(vectors: DataFrame, names: DataFrame, pairs: DataFrame) -> DataFrame:
    """vectors(vid, ...) without those of the entities names(name) and of the relations pairs(a, b), whichever way round these were stored."""
    rel = lambda x, y: F.concat(F.lit("rel-"), F.md5(F.concat(x, y)))
    gone = names.select(F.concat(F.lit("ent-"), F.md5("name")).alias("vid")).unionByName(pairs.select(F.explode(F.array(rel("a", "b"), rel("b", "a"))).alias("vid")))
    return vectors.join(gone.distinct(), "vid", "left_anti")


def insert_custom(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored chunks, nodes and edges of a graph that a user supplies.

    chunks(source_id, content), entities(name, type, description, source_id), relations(a, b,
    description, keywords, weight, source_id). A source_id becomes the id of the chunk that was
    given under it ('chunk-' and the content's MD5; the least of several), UNKNOWN if there is
    none. Ends of relations that are no entity become UNKNOWN nodes, described by the relation that
    names them first in code-point order.
    """
    stored = chunks.select("source_id", "content", F.concat(F.lit("chunk-"), F.md5(F.coalesce("content", F.lit("")))).alias("chunk_id"))
    ids = stored.groupBy("source_id").agg(F.min("chunk_id").alias("chunk_id"))

    def mapped(df: DataFrame) -> DataFrame:
        return df.join(ids, "source_id", "left").withColumn("chunk_id", F.coalesce("chunk_id", F.lit("UNKNOWN"))).drop("source_id")

    nodes, edges = mapped(entities).select("name", "type", "description", "chunk_id"), mapped(relations)
    ends = edges.select(F.explode(F.array("a", "b")).alias("name"), "description", "chunk_id").join(entities.select("name").distinct(), "name", "left_anti")
    first = ends.groupBy("name").agg(F.min(F.struct("description", "chunk_id")).alias("f"))
    unknown = first.select("name", F.lit("UNKNOWN").alias("type"), "f.description", "f.chunk_id")
    return stored.select("chunk_id", "content").distinct(), nodes.unionByName(unknown), edges


def task_answers(tasks: DataFrame, hits: DataFrame, least: float, missing: str = "未找到") -> DataFrame:
    """(task_id, answer, number) of tasks(task_id): the answer of the best of hits(task_id, id, score, answer) with a score of least or more.

    A hit that says ``missing`` answers nothing; an answer that is a number with or without a unit
    is given as a number too. A task without a hit has a blank answer.
    """
    good = hits.where(F.col("score") >= least)
    best = good.groupBy("task_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id", "answer"))["answer"].alias("answer"))
    a = tasks.select("task_id").join(best, "task_id", "left")
    said = F.coalesce(F.when(~F.col("answer").contains(missing), F.trim("answer")), F.lit(""))
    return a.select("task_id", said.alias("answer")).withColumn("number", to_number(F.col("answer")))
