"""A stored full-text index: postings by term, read for the terms of a search only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.text import terms
from lakeloom.session import materialize

#: Queries and documents whose scores a task holds at once; rounding to six digits joins scores that are up to 1e-6 apart.
QUERY_BLOCK, DOC_BLOCK, MARGIN = 512, 4096, 2e-6


class TextIndex:
    """Below a folder: ``postings`` (term, id, tf, dl) and ``terms`` (term, df), by batch and bucket of the term; ``sizes`` by batch.

    A bucket's files are sorted by term, so a search reads the buckets of its terms and in them the
    row groups that may hold these. A batch of documents that is indexed again replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, tokens: Callable[[Column], Column] = terms) -> None:
        self.spark, self.path, self.buckets, self.tokens = spark, path, buckets, tokens

    def _bucket(self, term: str = "term") -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def insert(self, docs: DataFrame, batch: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Index new documents; null texts count as documents without terms, rows without an id are left out."""
        d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), self.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
        d = d.select("id", F.size("t").alias("dl"), "t")
        found = d.select("id", "dl", F.explode("t").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
        postings = materialize(found.withColumn("bucket", self._bucket()), "postings")
        kept = postings.select("term", "id", "tf", "dl", "bucket").hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id")
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
        counts = postings.groupBy("bucket", "term").agg(F.count("*").alias("df"))
        counts.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/terms/batch={batch}")
        d.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).write.mode("overwrite").parquet(f"{self.path}/sizes/batch={batch}")

    def _table(self, name: str, wanted: DataFrame, few: list[str] | None) -> DataFrame:
        """Rows of the wanted(term): their buckets only; for a few terms the reader also gets these."""
        t = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        if few is not None:
            hit = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]
            t = t.where(F.col("bucket").isin(hit)).where(F.col("term").isin(few))
        return t.drop("batch", "bucket")

    def search(self, queries: DataFrame, k: int | None = None, all_terms: bool = False, k1: float = 1.5, b: float = 0.75, most_pushed: int = 200) -> DataFrame:
        """(qid, id, score, matched, rank): BM25 of queries(qid, term), a row a term, repeated ones once; the k best by score and id.

        Figures and scores are those of a scan of all documents. Up to most_pushed different terms
        are pushed into the reader; more are joined. all_terms keeps documents that have every term.
        Blocks of queries meet blocks of documents, and with k each pair of blocks sends what may be among the k best.
        """
        q = materialize(queries.where("qid IS NOT NULL AND term IS NOT NULL").select("qid", "term").distinct(), "search-terms")
        wanted = q.select("term").distinct()
        some = [r.term for r in wanted.limit(most_pushed + 1).collect()]
        few = some if len(some) <= most_pushed else None
        size = self.spark.read.parquet(f"{self.path}/sizes").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avgdl"))
        counts = self._table("terms", wanted, few).join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        idf = counts.crossJoin(F.broadcast(size)).select("term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # one row of sizes
        asked = q.join(idf, "term")
        needed = q.groupBy("qid").agg(F.count("*").cast("int").alias("needed"))
        asked = asked.join(needed, "qid").withColumn("q_block", self._block("qid", q.select("qid").distinct().count(), QUERY_BLOCK)[0])
        over = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
        n_docs = self.spark.read.parquet(f"{self.path}/sizes").agg(F.sum("n")).first()[0] or 0
        block, blocks = self._block("id", n_docs, DOC_BLOCK)
        p = self._table("postings", wanted, few).join(idf, "term").select("term", "id", "tf", over.alias("over"), block.alias("d_block"))
        if (many := asked.agg(F.max("q_block")).first()[0] or 0):
            p = p.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(many))))
        else:
            p = p.withColumn("q_block", F.lit(0))
        asked = asked.select("q_block", "qid", "term", "idf", "needed", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("d_block"))
        kinds = [dict(x.dtypes)[c] for x, c in ((asked, "qid"), (p, "id"))]
        by = ["q_block", "d_block"]
        found = asked.groupBy(*by).cogroup(p.groupBy(*by)).applyInArrow(_scores(k, all_terms, k1), f"qid {kinds[0]}, id {kinds[1]}, score double, matched int")
        found = found.withColumn("score", F.round("score", 6))
        out = found.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id")))
        return out if k is None else out.where(F.col("rank") <= k)

    @staticmethod
    def _block(key: str, n: int, most: int) -> tuple[Column, int]:
        """Which of how many blocks of about ``most`` rows."""
        blocks = max(1, -(-n // most))
        return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), blocks


def _scores(k: int | None, all_terms: bool, k1: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores of a block of queries with a block of documents, term by term in their order; with k, what may be among a query's first k."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked, held = asked.sort_by("term"), held.sort_by("term")
        qids, q = _coded(asked.column("qid"))
        ids, d = _coded(held.column("id"))
        _, w = _coded(pa.chunked_array([*asked.column("term").chunks, *held.column("term").chunks], asked.schema.field("term").type))
        wq, wd = w[: len(q)], w[len(q) :]
        n = int(wq.max(initial=-1)) + 1
        mine = wd < n  # terms of other blocks' queries come after, so what is left is in order
        wd, d = wd[mine], d[mine]
        q_at, d_at = np.searchsorted(wq, np.arange(n + 1)), np.searchsorted(wd, np.arange(n + 1))
        idf, tf, over = asked.column("idf").to_numpy(), held.column("tf").to_numpy()[mine], held.column("over").to_numpy()[mine]
        twice = len(np.unique(wd.astype(np.int64) * max(1, len(ids)) + d)) < len(d)  # a document in two batches
        score, matched = np.zeros((len(qids), len(ids))), np.zeros((len(qids), len(ids)), np.int32)
        for t in range(n):
            i, j = slice(q_at[t], q_at[t + 1]), slice(d_at[t], d_at[t + 1])
            if i.start < i.stop and j.start < j.stop:
                at = np.ix_(q[i], d[j])
                part = idf[i][:, None] * tf[j][None, :] * (k1 + 1) / over[j][None, :]
                if twice:
                    np.add.at(score, at, part)
                    np.add.at(matched, at, 1)
                else:
                    score[at] += part
                    matched[at] += 1
        keep = matched > 0
        if all_terms:
            needed = np.zeros(len(qids), np.int32)
            needed[q] = asked.column("needed").to_numpy()
            keep &= matched == needed[:, None]
        if k is not None and 0 < k < len(ids):
            s = np.where(keep, score, -np.inf)
            keep &= s >= np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k, None] - MARGIN
        i, j = np.nonzero(keep)
        return pa.table({"qid": qids.take(pa.array(i)), "id": ids.take(pa.array(j)), "score": score[i, j], "matched": matched[i, j]})

    return run


def _coded(c: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values in the order in which they come, and each row's place in them; terms that come in order stay so."""
    x = c.combine_chunks()
    x = (x.chunk(0) if x.num_chunks else pa.array([], x.type)) if isinstance(x, pa.ChunkedArray) else x
    e = x.dictionary_encode()
    return e.dictionary, e.indices.to_numpy(zero_copy_only=False)
