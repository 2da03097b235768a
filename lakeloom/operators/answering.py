"""Whole ways to an answer: documents by fused lists and a reranker, sources asked one after another, tables filled by search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators.model_slots import Slot, rerank_pairs
from lakeloom.operators.modes import candidates
from lakeloom.operators.tables import fill_answers, pivot_answers, typed_table
from lakeloom.operators.text_index import TextIndex
from lakeloom.operators.upkeep import task_answers
from lakeloom.session import materialize


def fused(lists: list[DataFrame], mentions: DataFrame | None = None, rrf_k: int = 60, weight: float = 1.0) -> DataFrame:
    """(qid, id, score): reciprocal ranks of lists(qid, id, rank) summed, and weight * n / rrf_k for mentions(qid, id, n) of the graph.

    What only the graph mentions is in. Scores are rounded to eight digits.
    """
    parts = [x.select("qid", "id", (1 / (F.lit(float(rrf_k)) + F.col("rank"))).alias("s")) for x in lists]
    if mentions is not None:
        parts.append(mentions.select("qid", "id", (F.col("n") * weight / rrf_k).alias("s")))
    return reduce(DataFrame.unionByName, parts).groupBy("qid", "id").agg(F.round(F.sum("s"), 8).alias("score"))


def document_answers(questions: DataFrame, lists: list[DataFrame], mentions: DataFrame | None, texts: DataFrame, k: int, slots: dict[str, Slot], least: float | None = None) -> DataFrame:
    """(qid, pos, id, score, model_score, fell_back): the document mode with its reranker, for questions(qid, mode, query) all at once.

    Lists and mentions (see fused) are fused, the best candidates(k) of each question get their
    text from texts(id, text), and the model of the question's mode orders these; where it fails
    the fused order stays. Ids without a text are left out before the model sees them; a
    question without hits has no rows.
    """
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    cut = fused(lists, mentions).join(texts.select("id", "text").where("text IS NOT NULL"), "id").withColumn("rank", rank).where(F.col("rank") <= candidates(k))
    cut = materialize(cut.join(questions.select("qid", "mode", "query"), "qid"), "document-hits")
    best = rerank_pairs(cut, slots, k, least)
    return best.join(cut.select("qid", "id", "score"), ["qid", "id"]).select("qid", "pos", "id", "score", "model_score", "fell_back")


@dataclass
class Stage:
    """A source of answers: ask(questions) gives (qid, answer, ...), accept judges a row; the first of order counts."""

    name: str
    ask: Callable[[DataFrame], DataFrame]
    accept: Column
    order: str = "answer"


def ask_in_turn(questions: DataFrame, stages: list[Stage]) -> DataFrame:
    """(qid, stage, answer, tried) of questions(qid, ...): the first stage with an accepted answer.

    A stage is asked only what the stages before left open, so dear ones at the end see little.
    tried counts the stages asked; a question that none answers has a null stage and answer. A
    judge that gives null doesn't accept. Null qids are left out, repeated ones are one question.
    """
    left = materialize(questions.where("qid IS NOT NULL").dropDuplicates(["qid"]), "open-questions")
    done = []
    for n, stage in enumerate(stages, 1):
        good = stage.ask(left).where(F.coalesce(stage.accept, F.lit(False)) & F.col("answer").isNotNull())
        best = good.groupBy("qid").agg(F.min(F.struct(F.col(stage.order).alias("o"), F.col("answer").cast("string").alias("answer")))["answer"].alias("answer"))
        found = materialize(best.select("qid", F.lit(stage.name).alias("stage"), "answer", F.lit(n).alias("tried")).join(left.select("qid"), "qid", "left_semi"), "answers")
        done.append(found)
        left = materialize(left.join(found.select("qid"), "qid", "left_anti"), "open-questions")
    rest = left.select("qid", F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("answer"), F.lit(len(stages)).alias("tried"))
    return reduce(DataFrame.unionByName, [*done, rest])


def filled_table(index: TextIndex, docs: DataFrame, grid: DataFrame, question: Column, read: Column, metrics: list[str], k: int = 5, least: float = 0.0, all_terms: bool = True) -> DataFrame:
    """A generated table: (entity, time, metrics...) of grid(task_id, entity, time, metric), every cell found by a search.

    question is an expression on the grid; its terms are searched in the index of docs(id, text),
    and read, an expression on a hit and its task, reads the answer (null or blank: nothing there).
    The best hit that answers fills the cell, as a number where it is one with or without a unit.
    """
    tasks = materialize(grid.withColumn("question", question), "tasks")
    asked = tasks.select(F.col("task_id").alias("qid"), F.explode(index.tokens(F.col("question"))).alias("term"))
    hits = index.search(asked, k, all_terms=all_terms).select(F.col("qid").alias("task_id"), "id", "score")
    found = hits.join(docs.select("id", "text"), "id").join(tasks, "task_id").select("task_id", "id", "score", read.alias("answer"))
    cells = task_answers(tasks, found.where("coalesce(trim(answer), '') <> ''"), least)
    number = F.coalesce(F.col("number").cast("decimal(28,6)").cast("string"), F.col("answer"))
    answers = tasks.join(cells, "task_id").select("entity", "time", "metric", number.alias("answer"))
    return typed_table(pivot_answers(fill_answers(grid, answers), metrics), metrics)
