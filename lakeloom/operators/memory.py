"""Fact memory: scope filters, search, ingest decisions, history and its fold, short-term windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.vectors import cosine

SCOPE_KEYS = ("user_id", "agent_id", "run_id")
#: Keys of a fact's payload that become columns; the rest stays in a map.
PROMOTED = ("user_id", "agent_id", "run_id", "actor_id", "role")


def scope_filter(filters: dict[str, object]) -> Column:
    """Equality on every key."""
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in filters.items()], F.lit(True))


def build_scope(user_id: str | None = None, agent_id: str | None = None, run_id: str | None = None, actor_id: str | None = None, filters: dict | None = None) -> dict:
    """Scope of a call; at least one of user, agent and run is required, and the actor argument wins over the filter's."""
    scope = dict(filters or {})
    scope |= {k: v for k, v in zip((*SCOPE_KEYS, "actor_id"), (user_id, agent_id, run_id, actor_id), strict=True) if v is not None}
    if not any(scope.get(k) for k in SCOPE_KEYS):
        raise ValueError("one of user_id, agent_id and run_id is required")
    return scope


def split_metadata(payload: Column) -> list[Column]:
    """The promoted keys of a map as columns, and a map of the others."""
    rest = F.map_filter(payload, lambda k, v: ~k.isin(*PROMOTED, "data", "hash", "created_at", "updated_at"))
    return [*[F.try_element_at(payload, F.lit(k)).alias(k) for k in PROMOTED], rest.alias("metadata")]


def search(facts: DataFrame, query: DataFrame, filters: dict, k: int = 100, threshold: float | None = None) -> DataFrame:
    """(id, score) of the facts in scope nearest to query(q) by cosine, those under the threshold left out after the cut."""
    f = facts.where(scope_filter(filters)).crossJoin(F.broadcast(query.limit(1)))  # one row
    f = f.select("id", F.round(cosine("embedding", "q"), 6).alias("score")).where("score IS NOT NULL")
    f = f.orderBy(F.desc("score"), "id").limit(k)
    return f if threshold is None else f.where(F.col("score") >= threshold)


def raw_facts(turns: DataFrame) -> DataFrame:
    """(id, data, hash, role): one fact for each message that is not the system's."""
    t = turns.where("role <> 'system' AND text IS NOT NULL")
    return t.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("data"), F.md5("text").alias("hash"), "role")


def decide(new: DataFrame, similar: DataFrame, same: float = 0.999, near: float = 0.9) -> DataFrame:
    """(fact_id, event, memory_id) for new(fact_id) with similar(fact_id, memory_id, score): the built-in rule.

    The best match decides: NONE if it is practically the same, UPDATE if near, ADD otherwise.
    """
    best = similar.groupBy("fact_id").agg(F.max_by("memory_id", F.struct("score", "memory_id")).alias("memory_id"), F.max("score").alias("score"))
    d = new.join(best, "fact_id", "left")
    event = F.when(F.col("score") >= same, "NONE").when(F.col("score") >= near, "UPDATE").otherwise("ADD")
    return d.select("fact_id", event.alias("event"), F.when(F.col("score") >= near, F.col("memory_id")).alias("memory_id"))


def current_state(history: DataFrame) -> DataFrame:
    """Latest event of each memory, deleted ones left out."""
    rn = F.row_number().over(W.partitionBy("memory_id").orderBy(F.desc("created_at"), F.desc("id")))
    return history.withColumn("_rn", rn).where("_rn = 1 AND event <> 'DELETE'").drop("_rn")


def last_messages(turns: DataFrame, k: int = 10) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("_rn", rn).where(F.col("_rn") <= k).drop("_rn")


def paired_turns(turns: DataFrame, last: int = 3) -> DataFrame:
    """(conv_id, pair, user_text, assistant_text): consecutive non-overlapping positions with both roles, the last ones."""
    w = W.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumn("i", F.row_number().over(w) - 1).withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    t = t.where("i % 2 = 0 AND next_role IS NOT NULL")
    t = t.where("(role = 'user' AND next_role = 'assistant') OR (role = 'assistant' AND next_role = 'user')")
    user = F.when(F.col("role") == "user", F.col("text")).otherwise(F.col("next_text"))
    answer = F.when(F.col("role") == "user", F.col("next_text")).otherwise(F.col("text"))
    rn = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("i")))
    out = t.select("conv_id", (F.col("i") / 2).cast("long").alias("pair"), user.alias("user_text"), answer.alias("assistant_text"), rn.alias("_rn"))
    return out.where(F.col("_rn") <= last).drop("_rn")
