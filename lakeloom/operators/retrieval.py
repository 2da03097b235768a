"""Search and fusion: vector top-k, full text and BM25, rank fusion, composite scores, context assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.text import terms
from lakeloom.functions.vectors import inner_product
from lakeloom.operators.blocks import cosines


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in an order that must be total: TakeOrderedAndProject, no full sort."""
    return df.orderBy(*order).limit(k)


def vector_top_k(vectors: DataFrame, query: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, score): the k largest inner products, rounded to six digits, with the one vector in query(q)."""
    scored = vectors.select(id_col, vec_col).crossJoin(F.broadcast(query.select("q").limit(1)))  # one row
    scored = scored.select(id_col, F.round(inner_product(vec_col, "q"), 6).alias("score")).where("score IS NOT NULL")
    return top_k(scored, k, F.desc("score"), F.col(id_col))


def vector_top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """(qid, vec_id, score) for queries(qid, q[, group]) against vectors(vec_id, embedding[, group]).

    With a group column only vectors of the query's group compete, which prunes like the lists of
    an inverted-file index. Blocks of queries meet blocks of vectors, each pair of blocks keeps
    what may be among the k best, and a window takes these.
    """
    by = [group] if group else []
    both = cosines(queries.select(F.col("qid").alias("id"), F.col("q").alias("v"), *by), vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), *by), k, group=by)
    scored = both.select(F.col("a").alias("qid"), F.col("b").alias("vec_id"), F.round("cos", 6).alias("score"))
    best = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def best_other(vectors: DataFrame, queries: DataFrame, group: str) -> DataFrame:
    """(qid, vec_id, score): for queries(qid, q, group) the vector of another id in the group with the largest cosine, ties by id.

    A query that has a cosine with no other vector of its group gets the least id and no score.
    """
    v = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), group)
    both = cosines(queries.select(F.col("qid").alias("id"), F.col("q").alias("v"), group), v, 1, group=[group], other=True)
    scored = both.select(F.col("a").alias("qid"), F.col("b").alias("vec_id"), F.round("cos", 6).alias("score"))
    least = v.groupBy(group).agg(F.min("id").alias("least"))
    second = v.join(least, group).where("id > least").groupBy(group).agg(F.min("id").alias("second"))
    bare = queries.select("qid", group).join(least, group).join(second, group, "left")
    bare = bare.select("qid", F.when(F.col("qid") == F.col("least"), F.col("second")).otherwise(F.col("least")).alias("vec_id"), F.lit(None).cast("double").alias("score"))
    best = F.max_by(F.struct("vec_id", "score"), F.struct(F.col("score"), -F.col("vec_id"))).alias("b")
    return scored.unionByName(bare.where("vec_id IS NOT NULL")).groupBy("qid").agg(best).select("qid", "b.vec_id", "b.score")


def limit_ranks(hits: DataFrame, k: int) -> DataFrame:
    """Hits of each qid ranked anew, by score and id, the first k."""
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, dl): one row for each term of a document."""
    d = docs.select(id_col, terms(F.col(text_col)).alias("terms"))
    d = d.select(id_col, F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return d.groupBy(id_col, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def _times(word: str) -> Column:
    return F.size(F.filter("terms", lambda t: t == word))


def bm25(docs: DataFrame, query_terms: list[str], id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75, all_terms: bool = False, tokens: Callable[[Column], Column] = terms) -> DataFrame:
    """(id, score, matched): BM25 with idf ln(1 + (N - df + 0.5) / (df + 0.5)); all_terms keeps conjunctive matches.

    Term frequencies are counted by array filters on the scan, so only the query's terms are
    ever exploded; collection figures are one aggregate row, joined by broadcast. tokens cuts a
    text, for one by a learned segmenter.
    """
    wanted = sorted(set(query_terms))
    d = docs.select(id_col, tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
    d = d.select(id_col, F.size("terms").alias("dl"), *[_times(w).alias(f"tf{i}") for i, w in enumerate(wanted)])
    one = d.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(wanted))])
    d = d.where(" OR ".join(f"tf{i} > 0" for i in range(len(wanted)))).crossJoin(F.broadcast(one))  # one row
    score, matched = F.lit(0.0), F.lit(0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        matched = matched + (tf > 0).cast("int")
    out = d.select(id_col, F.round(score, 6).alias("score"), matched.alias("matched"))
    return out.where(F.col("matched") == len(wanted)) if all_terms else out


def ranked(df: DataFrame, id_col: str, score_col: str = "score", list_name: str = "l") -> DataFrame:
    """(list, id, rank): 1-based positions of a short list."""
    r = F.row_number().over(W.orderBy(F.desc(score_col), id_col))
    return df.select(F.lit(list_name).alias("list"), F.col(id_col).alias("id"), r.alias("rank"))


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """(id, score): sum of 1 / (k + rank) over ranked lists(list, id, rank)."""
    return lists.groupBy("id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 8).alias("score"))


def kg_boost(fused: DataFrame, occurrences: DataFrame, weight: float = 1.0, k: int = 60) -> DataFrame:
    """Adds count * weight / k of occurrences(id, n) to fused scores; ids in either are kept."""
    both = fused.join(occurrences, "id", "full")
    return both.select("id", F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("n", F.lit(0)) * weight / k, 8).alias("score"))


def composite(similar: DataFrame, occurrences: DataFrame, w_sim: float = 1.5, w_occ: float = 1.0) -> DataFrame:
    """Similarity times w_sim plus occurrences times w_occ for occurrences(id, n); a missing similarity is 0."""
    both = occurrences.join(similar.select("id", "sim"), "id", "left")
    return both.select("id", F.round(F.coalesce("sim", F.lit(0.0)) * w_sim + F.col("n") * w_occ, 8).alias("score"))


def rescore(per_dataset: DataFrame, w_sim: float = 1.5, w_occ: float = 1.0) -> DataFrame:
    """Global scores from (dataset_pos, id, score): the last dataset's score, weighted again with one occurrence."""
    last = per_dataset.groupBy("id").agg(F.max_by("score", "dataset_pos").alias("score"))
    return last.select("id", F.round(F.col("score") * w_sim + w_occ, 8).alias("score"))


def interleave(lists: DataFrame) -> DataFrame:
    """Round robin over lists(list_no, id, rank): first occurrence by (rank, list_no), with the position in the mix."""
    first = lists.groupBy("id").agg(F.min(F.struct("rank", "list_no")).alias("at"))
    pos = F.row_number().over(W.orderBy("at.rank", "at.list_no", "id"))
    return first.select("id", pos.alias("pos"))


def first_occurrence(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows with one key the first in the order."""
    rn = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def token_budget(rows: DataFrame, budget: int, order: str = "pos", tokens: str = "tokens", group: list[str] | None = None) -> DataFrame:
    """The prefix whose running sum of tokens (never negative) stays within the budget."""
    w = (W.partitionBy(*group) if group else W.partitionBy()).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(tokens).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def weighted_polling(chunks: DataFrame, n_groups: int, most: int = 5, least: int = 1) -> DataFrame:
    """Chosen rows of chunks(grp, rn, chunk_id) with the order in which they were chosen.

    Quotas fall linearly from most (group 0) to least, rounded half to even; a single group gets
    most. What groups leave unused goes, one by one, to the earliest that have more.
    """
    share = F.lit(float(most)) if n_groups < 2 else F.lit(float(most)) - F.col("grp") / F.lit(n_groups - 1) * F.lit(most - least)
    c = chunks.withColumn("quota", F.bround(share, 0).cast("long"))
    quotas = sum(round(most - i / (n_groups - 1) * (most - least)) for i in range(n_groups)) if n_groups > 1 else 0  # empty groups have one too
    used = c.groupBy("grp").agg(F.least(F.max("rn"), F.first("quota")).alias("used"))
    spare = used.agg((F.lit(quotas) - F.sum("used")).alias("spare"))
    firsts = c.where("rn <= quota").select("grp", "rn", "chunk_id", F.lit(0).alias("pass"))
    more = c.where("rn > quota").withColumn("turn", F.row_number().over(W.orderBy("grp", "rn")))
    more = more.crossJoin(F.broadcast(spare)).where("turn <= spare").select("grp", "rn", "chunk_id", F.lit(1).alias("pass"))
    return firsts.unionByName(more).withColumn("pos", F.row_number().over(W.orderBy("pass", "grp", "rn")))
