"""Retrieval modes composed of search, fusion and graph operators; model calls are slots with rule defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators.retrieval import first_occurrence, token_budget, weighted_polling
from lakeloom.session import materialize


def candidates(k: int, factor: int = 3, most: int = 50) -> int:
    """How many hits a search fetches so that k are left after later cuts."""
    return min(factor * k, most)


def variant_union(hits: DataFrame, most: int = 3) -> DataFrame:
    """(id, variant, rank): hits(variant, rank, id) of a query's first ``most`` rewritings, each id where it comes first.

    Variant 0 is the query itself, which stays when no rewriting is there.
    """
    kept = hits.where(F.col("variant") <= most)
    return first_occurrence(kept, "id", "variant", "rank").select("id", "variant", "rank")


def multi_hop(start: DataFrame, hop: Callable[[DataFrame], DataFrame], rounds: int = 3, enough: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """(id, hop): what start(id) finds at hop 0 and every later round by hop(ids), at its first round.

    A round sees only what the one before found. It ends when a round finds nothing new, when
    enough(found so far) says so, or after ``rounds``.
    """
    seen = materialize(start.select("id").distinct().withColumn("hop", F.lit(0)), "hops")
    frontier = seen
    for n in range(1, rounds + 1):
        if enough is not None and enough(seen):
            break
        found = hop(frontier.select("id")).select("id").distinct().join(seen, "id", "left_anti")
        frontier = materialize(found.withColumn("hop", F.lit(n)), "hops")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def mode_for(low: Column, high: Column) -> Column:
    """The memory mode by keywords: only low-level ones are local, only high-level ones global, none at all fails."""
    some = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return F.when(some(low) & some(high), "hybrid").when(some(low), "local").when(some(high), "global").otherwise("fail")


def interleaved(lists: DataFrame) -> DataFrame:
    """(qid, id, pos): round robin over lists(qid, list_no, rank, id) of each query, an id where it comes first."""
    first = lists.groupBy("qid", "id").agg(F.min(F.struct("rank", "list_no")).alias("at"))
    return first.select("qid", "id", F.row_number().over(W.partitionBy("qid").orderBy("at.rank", "at.list_no", "id")).alias("pos"))


def rerank(hits: DataFrame, score: Column | None, k: int, least: float | None = None) -> DataFrame:
    """(qid, id, pos): hits(qid, id, rank, ...) by score, those under least left out, the first k of each query.

    Without a model (score None), or where it scored none of a query's hits, the order stays.
    Hits without a score follow those that have one.
    """
    h = hits.withColumn("_score", F.lit(None).cast("double") if score is None else score)
    w = W.partitionBy("qid")
    h = h.withColumn("_scored", F.count("_score").over(w) > 0)
    if least is not None:
        h = h.where(~F.col("_scored") | (F.col("_score") >= least))
    pos = F.row_number().over(w.orderBy(F.desc_nulls_last("_score"), "rank", "id"))
    return h.withColumn("pos", pos).where(F.col("pos") <= k).drop("_score", "_scored")


def context_chunks(hits: DataFrame, score: Column | None, k: int, budget: int, least: float | None = None) -> DataFrame:
    """The one end of every mode: rerank, minimum score, top k, then the prefix within the token budget of each query."""
    return token_budget(rerank(hits, score, k, least), budget, group=["qid"])


def pick_chunks(chunks: DataFrame, scores: DataFrame, n_groups: int, most: int = 5) -> DataFrame:
    """(chunk_id, pos): int(most * groups / 2) chunks of chunks(grp, rn, chunk_id) by scores(chunk_id, score).

    If any chunk has no score, the weighted polling by groups decides instead.
    """
    one = chunks.select("chunk_id").distinct().join(scores, "chunk_id", "left")
    missing = one.agg(F.coalesce(F.max(F.col("score").isNull().cast("int")), F.lit(1)).alias("m"))
    if missing.first().m:
        return weighted_polling(chunks, n_groups, most).select("chunk_id", "pos")
    top = one.orderBy(F.desc("score"), "chunk_id").limit(int(most * n_groups / 2))
    return top.select("chunk_id", F.row_number().over(W.orderBy(F.desc("score"), "chunk_id")).alias("pos"))


def cascade(*stages: tuple[str, DataFrame, Column]) -> DataFrame:
    """(qid, stage, answer): of stages (name, answers(qid, answer, ...), accept) the first whose answer is accepted."""
    every = None
    for n, (name, answers, accept) in enumerate(stages):
        one = answers.where(F.coalesce(accept, F.lit(False))).select("qid", F.lit(n).alias("n"), F.lit(name).alias("stage"), F.col("answer").cast("string").alias("answer"))
        every = one if every is None else every.unionByName(one)
    return first_occurrence(every, "qid", "n", "answer").select("qid", "stage", "answer")
