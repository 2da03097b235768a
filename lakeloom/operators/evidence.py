"""Multi-hop search with evidence: typed nodes, the edges that led to each, a stop rule for each query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.session import discard, materialize

KEY = ["qid", "type", "id"]


def best_paths(start: DataFrame, edges: DataFrame, rounds: int = 3, beam: int | None = None, enough: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(qid, type, id, hop, score, path): for many queries at once what rounds of hops find, each node by its best path.

    start(qid, type, id, score) is hop 0. edges(edge, src_type, src, dst_type, dst, gain) lead on;
    a node's id counts within its type only. Of several paths to a node in one round the one of
    highest score (start plus gains, six digits) stays, then the first by its edges; a node that a
    query has seen keeps its earlier hop. beam keeps that many new nodes for each query and round,
    best first. enough(found so far) gives the qids that have what they need: these stop, the
    others go on. A round is one join whatever the number of queries; frontiers are tables in the
    shared folder. Null ids lead nowhere.
    """
    first = start.where("id IS NOT NULL").groupBy(*KEY).agg(F.max("score").alias("score"))
    seen = materialize(first.select(*KEY, F.lit(0).alias("hop"), F.round("score", 6).alias("score"), F.array().cast("array<string>").alias("path")), "evidence")
    frontier = seen
    for n in range(1, rounds + 1):
        live = frontier if enough is None else frontier.join(enough(seen).select("qid").distinct(), "qid", "left_anti")
        step = live.withColumnsRenamed({"type": "src_type", "id": "src"}).join(edges, ["src_type", "src"])
        step = step.select("qid", F.col("dst_type").alias("type"), F.col("dst").alias("id"), F.round(F.col("score") + F.col("gain"), 6).alias("score"), F.concat("path", F.array("edge")).alias("path"))
        step = step.where("id IS NOT NULL").groupBy(*KEY).agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("best"))
        step = step.join(seen.select(*KEY), KEY, "left_anti").select(*KEY, F.lit(n).alias("hop"), (-F.col("best.s")).alias("score"), "best.path")
        if beam is not None:
            rn = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "type", "id"))
            step = step.withColumn("_rn", rn).where(F.col("_rn") <= beam).drop("_rn")
        frontier = materialize(step, "evidence")
        if frontier.isEmpty():
            discard(frontier)
            break
        seen = seen.unionByName(frontier)
    return seen


def citations(paths: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, source, edges): the distinct sources of the edges on a query's paths, with how many edges cite each; sources(edge, source)."""
    used = paths.select("qid", F.explode("path").alias("edge")).distinct()
    return used.join(sources, "edge").groupBy("qid", "source").agg(F.count("*").alias("edges"))
