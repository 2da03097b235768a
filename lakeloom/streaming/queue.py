"""A queue of documents with a status each, drained until nothing is left to take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.session import children, get_text, materialize, remove
from lakeloom.sources.keyed import KeyedTable, logged
from lakeloom.streaming.history import file_stream, run_available


class DocumentQueue:
    """Documents that are PENDING, PROCESSING, FAILED or PROCESSED, and what processing gave for them.

    A drain takes all that is pending, has failed fewer times than allowed, or has been in work
    for too long; marks it, processes it as one job, and marks the outcome; and takes again what
    has come meanwhile. What a round gives is written whole before any status says so: a run that
    dies in a round leaves its documents in work, to be taken again when they are stale, and a run
    that dies between outcome and status is completed by the next one, so results count once.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32) -> None:
        self.spark, self.path = spark, path
        self.status = KeyedTable(spark, f"{path}/status", "doc_id string, status string, attempts int, updated long, error string, round string", ["doc_id"], buckets)
        self.content = KeyedTable(spark, f"{path}/content", "doc_id string, text string", ["doc_id"], buckets)

    def enqueue(self, docs: DataFrame, tag: str, now: int = 0) -> None:
        """Add docs(doc_id, text) that aren't known yet as PENDING; of equal ids in one batch the least text. Null ids go."""

        def changes() -> dict[str, DataFrame]:
            d = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.min("text").alias("text"))
            d = d.join(self.status.lookup(d).select("doc_id"), "doc_id", "left_anti")
            none = F.lit(None).cast("string")
            s = d.select("doc_id", F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), F.lit(now).cast("long").alias("updated"), none.alias("error"), none.alias("round"), F.lit(False).alias("gone"))
            return {"content": d.withColumn("gone", F.lit(False)), "status": s}

        found = logged(self.spark, f"{self.path}/arrivals", tag, changes)
        self.content.replace(found["content"], tag)
        self.status.replace(found["status"], f"add {tag}")

    def scan(self, folder: str, schema: str, checkpoint: str, now: int = 0) -> None:
        """Enqueue the new Parquet files of a folder, as a stream that ends when all that is there was read."""
        run_available(file_stream(self.spark, folder, schema), checkpoint, lambda batch, n: self.enqueue(batch, f"scan{n}", now))

    def _rounds(self) -> list[str]:
        return sorted(n for n in children(self.spark, f"{self.path}/rounds") if get_text(self.spark, f"{self.path}/rounds/{n}/done") is not None)

    def _settle(self, name: str) -> None:
        """Give every document of a complete round its outcome, if it has none yet."""
        done = self.spark.read.parquet(f"{self.path}/rounds/{name}/results").select("doc_id", "ok", F.col("error").alias("why"))
        s = self.status.lookup(done).where((F.col("round") == name) & (F.col("status") == "PROCESSING")).join(done, "doc_id")
        s = s.select("doc_id", F.when(F.col("ok"), "PROCESSED").otherwise("FAILED").alias("status"), "attempts", "updated", F.when(~F.col("ok"), F.coalesce("why", F.lit("failed"))).alias("error"), "round", F.lit(False).alias("gone"))
        self.status.replace(s)

    def take(self, name: str, now: int, stale: int, attempts: int) -> DataFrame:
        """Mark what is due as in work in the round of that name; (doc_id, attempts) of it."""
        s = self.status.read()
        due = (F.col("status") == "PENDING") | ((F.col("status") == "FAILED") & (F.col("attempts") < attempts)) | ((F.col("status") == "PROCESSING") & (F.col("updated") <= now - stale))
        picked = s.where(due).select("doc_id", F.lit("PROCESSING").alias("status"), (F.col("attempts") + 1).alias("attempts"), F.lit(now).cast("long").alias("updated"), F.lit(None).cast("string").alias("error"), F.lit(name).alias("round"), F.lit(False).alias("gone"))
        picked = logged(self.spark, f"{self.path}/picks", name, lambda: {"picked": picked})["picked"]
        self.status.replace(picked, f"take {name}")
        return picked.select("doc_id", "attempts")

    def drain(self, process: Callable[[DataFrame], DataFrame], now: int, stale: int = 3600, attempts: int = 3, arrivals: Callable[[], None] | None = None) -> int:
        """Rounds until nothing is due; how many there were.

        process gets (doc_id, attempts, text) and gives (doc_id, ok, error, output): one row for each
        document, of which those without a row have failed. arrivals is called before each round
        and may enqueue more. now and stale are seconds on a clock of the caller's.
        """
        for name in self._rounds():
            self._settle(name)
        n = 0
        while True:
            if arrivals is not None:
                arrivals()
            name = f"r{len(children(self.spark, f'{self.path}/picks')):06d}"
            picked = self.take(name, now, stale, attempts)
            if picked.isEmpty():
                remove(self.spark, f"{self.path}/picks/{name}")
                return n
            rows = self.content.lookup(picked).join(picked, "doc_id").select("doc_id", "attempts", "text")

            def results(rows: DataFrame = rows, picked: DataFrame = picked) -> dict[str, DataFrame]:
                out = process(rows).groupBy("doc_id").agg(F.min("ok").alias("ok"), F.min("error").alias("error"), F.min("output").alias("output"))
                return {"results": picked.select("doc_id").join(out, "doc_id", "left").select("doc_id", F.coalesce("ok", F.lit(False)).alias("ok"), "error", F.col("output").cast("string").alias("output"))}

            logged(self.spark, f"{self.path}/rounds", name, results)
            self._settle(name)
            n += 1

    def repair(self) -> DataFrame:
        """(doc_id, status, action): documents with a status but no content; failed ones are kept to be looked at, others removed."""
        lost = self.status.read().join(self.content.read().select("doc_id"), "doc_id", "left_anti")
        found = materialize(lost.select("doc_id", "status", F.when(F.col("status") == "FAILED", "kept").otherwise("removed").alias("action")), "queue-lost")
        gone = found.where("action = 'removed'").join(self.status.read().drop("status"), "doc_id")
        self.status.replace(gone.select(*self.status.columns, F.lit(True).alias("gone")))
        return found

    def outputs(self) -> DataFrame:
        """(doc_id, output) of the processed documents, each from the round that its status names."""
        done = self.status.read().where("status = 'PROCESSED'").select("doc_id", "round")
        rounds = self._rounds()
        if not rounds:
            return done.select("doc_id", F.lit(None).cast("string").alias("output")).limit(0)
        parts = [self.spark.read.parquet(f"{self.path}/rounds/{n}/results").select("doc_id", "output", F.lit(n).alias("round")) for n in rounds]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.join(done, ["doc_id", "round"]).select("doc_id", "output")
