"""Streams: event history folded to its current state, short-term buffers, new files, windows over events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakeloom.operators.memory import current_state
from lakeloom.session import remove, written
from lakeloom.sources.keyed import KeyedTable
from lakeloom.sources.writers import upsert


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder, as a stream: the scan for new uploads."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is there, then stop: the queue's drain."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def fold_history(spark: SparkSession, path: str, schema: str, checkpoint: str, state_path: str) -> DataFrame:
    """Current state of history(id, memory_id, event, new_memory, created_at), merged batch by batch into a versioned table.

    Each batch writes the next version from the last one, so a batch that is run again after a
    failure writes the same version. The version before the last stays for that; older ones go. A
    run that finds no new file gives the state of the last run; before any file it is empty.
    """

    def each(batch: DataFrame, number: int) -> None:
        before = f"{state_path}/v{number - 1}"
        rows = batch.dropDuplicates(["id"])
        if number > 0:
            rows = upsert(spark.read.parquet(before), rows, ["memory_id"], "created_at", "id")
        else:
            rows = upsert(rows.limit(0), rows, ["memory_id"], "created_at", "id")
        rows.write.mode("overwrite").parquet(f"{state_path}/v{number}")
        remove(spark, f"{state_path}/v{number - 2}")

    run_available(file_stream(spark, path, schema, 1), checkpoint, each)
    versions = [int(n[1:]) for n in written(spark, state_path)]
    if not versions:
        return current_state(spark.createDataFrame([], schema))
    return current_state(spark.read.parquet(f"{state_path}/v{max(versions)}"))


def fold_history_by_key(spark: SparkSession, path: str, schema: str, checkpoint: str, state_path: str, buckets: int = 64) -> DataFrame:
    """Current state of history(id, memory_id, event, new_memory, created_at), merged batch by batch into a keyed table.

    Unlike fold_history, whose versions are whole tables, a batch rewrites only the buckets of the
    memories it names. One that is run again after a failure finds its own mark and changes
    nothing, or starts afresh if it was not complete. A run that finds no new file gives the state
    of the last run; before any file it is empty. Rows without a memory_id are left out.
    """
    table = KeyedTable(spark, state_path, schema, ["memory_id"], buckets)

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.where("memory_id IS NOT NULL").dropDuplicates(["id"])
        changed = upsert(table.lookup(rows), rows, ["memory_id"], "created_at", "id")
        table.replace(changed.withColumn("gone", F.lit(False)), str(number))
        table.vacuum()

    run_available(file_stream(spark, path, schema, 1), checkpoint, each)
    return current_state(table.read())


def short_term(stream: DataFrame, k: int = 10) -> DataFrame:
    """(conv_id, n, last_text): of each conversation of a stream(conv_id, turn, text) a buffer of its k latest messages."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            kept += list(zip(pdf["turn"].tolist(), pdf["text"].tolist(), strict=True))
        kept = sorted(kept, key=lambda x: x[0])[-k:]
        state.update(([t for t, _ in kept], [x for _, x in kept]))
        yield pd.DataFrame({"conv_id": [key[0]], "n": [len(kept)], "last_text": [kept[-1][1]]})

    return stream.groupBy("conv_id").applyInPandasWithState(
        step, "conv_id long, n long, last_text string", "turns array<long>, texts array<string>", "update", GroupStateTimeout.NoTimeout
    )


def event_windows(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) of events by tumbling windows; with late, a watermark for streams."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, n) of events by gaps of a user's events."""
    g = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("s.start").alias("session_start"), "n")
