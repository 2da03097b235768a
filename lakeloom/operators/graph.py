"""Graph operators over node and edge tables; edges are undirected unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.text import has_cjk
from lakeloom.plans.components import connected_components
from lakeloom.session import materialize


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over both endpoints of edges(node1, node2); a self-loop counts twice."""
    return edges.select(F.explode(F.array("node1", "node2")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def edge_ranks(edges: DataFrame) -> DataFrame:
    """Edges with rank: the sum of their endpoints' degrees."""
    d = degrees(edges)
    e = edges.join(d.select(F.col("node").alias("node1"), F.col("degree").alias("d1")), "node1")
    e = e.join(d.select(F.col("node").alias("node2"), F.col("degree").alias("d2")), "node2")
    return e.withColumn("rank", F.col("d1") + F.col("d2")).drop("d1", "d2")


def one_hop(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct edges that touch names(node) at either end: a union of two equi-joins, not an OR."""
    a = edges.join(names.withColumnRenamed("node", "node1"), "node1", "left_semi")
    b = edges.join(names.withColumnRenamed("node", "node2"), "node2", "left_semi")
    return a.unionByName(b).distinct()


def limit_per_parent(rows: DataFrame, parent: str, k: int, *order: Column | str) -> DataFrame:
    rn = F.row_number().over(W.partitionBy(parent).orderBy(*order))
    return rows.withColumn("_rn", rn).where(F.col("_rn") <= k).drop("_rn")


def endpoints(edges: DataFrame) -> DataFrame:
    """(node, pos): endpoint nodes of edges(pos, node1, node2) in first-seen order."""
    e = edges.select("pos", F.posexplode(F.array("node1", "node2")).alias("side", "node"))
    first = e.groupBy("node").agg(F.min(F.struct("pos", "side")).alias("at"))
    return first.select("node", F.row_number().over(W.orderBy("at")).alias("pos"))


def remap(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """node1 and node2 by mapping(name, canonical), themselves where unmapped; edges with an empty end go."""
    m = mapping.select("name", "canonical")
    e = edges.join(m.select(F.col("name").alias("node1"), F.col("canonical").alias("c1")), "node1", "left")
    e = e.join(m.select(F.col("name").alias("node2"), F.col("canonical").alias("c2")), "node2", "left")
    e = e.withColumn("node1", F.coalesce("c1", "node1")).withColumn("node2", F.coalesce("c2", "node2")).drop("c1", "c2")
    return e.where("coalesce(trim(node1), '') <> '' AND coalesce(trim(node2), '') <> ''")


def merge_nodes(records: DataFrame) -> DataFrame:
    """records(name, type, description, source_id, pos) -> one row a name.

    The most frequent type wins, the first seen on ties; descriptions are distinct and sorted,
    sources distinct, joined by <SEP>.
    """
    kinds = records.groupBy("name", "type").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = kinds.groupBy("name").agg(F.max_by("type", F.struct(F.col("n"), -F.col("first"))).alias("type"))
    rest = records.groupBy("name").agg(
        F.array_join(F.array_sort(F.collect_set("description")), "<SEP>").alias("description"),
        F.array_join(F.array_sort(F.collect_set("source_id")), "<SEP>").alias("source_id"),
    )
    return best.join(rest, "name")


def merge_edges(edges: DataFrame, weight: str = "sum") -> DataFrame:
    """Parallel edges(node1, node2, keywords, weight, source_id) as one a sorted pair; self-loops go.

    Weights are summed on ingest and maximised when entities are merged; keywords are the sorted
    distinct comma-separated ones.
    """
    e = edges.where("node1 <> node2").withColumn("a", F.least("node1", "node2")).withColumn("b", F.greatest("node1", "node2"))
    words = F.filter(F.transform(F.split("keywords", ","), lambda x: F.trim(x)), lambda x: x != "")
    total = F.sum("weight") if weight == "sum" else F.max("weight")
    return e.groupBy("a", "b").agg(
        F.round(total, 6).alias("weight"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(words)))), ",").alias("keywords"),
        F.array_join(F.array_sort(F.collect_set("source_id")), "<SEP>").alias("source_id"),
    )


def subgraph(edges: DataFrame, start: DataFrame, max_depth: int = 3, max_nodes: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, depth), induced edges, and a one-row table with is_truncated, of a breadth-first search from start(node).

    A level at a time; within a level nodes of high degree come first, then by name. A level's
    frontier is a table, so the search is max_depth joins whatever the graph's size.
    """
    both = edges.select(F.col("node1").alias("a"), F.col("node2").alias("b")).unionByName(edges.select(F.col("node2").alias("a"), F.col("node1").alias("b")))
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = both.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        frontier = found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        frontier = materialize(frontier, "bfs")
        seen = seen.unionByName(frontier)
    d = seen.join(degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    kept = d.orderBy("depth", F.desc("degree"), "node").limit(max_nodes).select("node", "depth")
    kept = materialize(kept, "bfs-nodes")
    inside = edges.join(kept.select(F.col("node").alias("node1")), "node1", "left_semi").join(kept.select(F.col("node").alias("node2")), "node2", "left_semi")
    return kept, inside, seen.agg((F.count("*") > max_nodes).alias("is_truncated"))


def alias_groups(pairs: DataFrame) -> DataFrame:
    """(name, canonical) of alias pairs(a, b): the canonical name has CJK characters, then is longest, then first."""
    parts = connected_components(pairs)
    order = F.struct(has_cjk(F.col("id")).cast("int").alias("c"), F.length("id").alias("n"))
    best = parts.withColumn("rank", F.row_number().over(W.partitionBy("component").orderBy(F.desc(order), "id"))).where("rank = 1")
    return parts.join(best.select("component", F.col("id").alias("canonical")), "component").select(F.col("id").alias("name"), "canonical")


def overlap_groups(sets: DataFrame) -> DataFrame:
    """(set_id, group) of sets(set_id, member): sets that share members, over others as well, are one group (their least id)."""
    first = sets.groupBy("member").agg(F.min("set_id").alias("b"))
    edges = sets.join(first, "member").select(F.col("set_id").alias("a"), "b").where("a <> b").distinct()
    parts = connected_components(edges)
    every = sets.select("set_id").distinct()
    return every.join(parts.withColumnRenamed("id", "set_id"), "set_id", "left").select("set_id", F.coalesce("component", "set_id").alias("group"))
