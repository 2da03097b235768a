"""Session defaults and the shared folder that cuts lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lakeloom", cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and bench share."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, one of our own on a local master; a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "lakeloom-checkpoints")
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: lineage ends there, on replicated storage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_at = path
    return out


def _folder(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, on whatever file system it lies."""
    files, where = _folder(spark, path)
    files.delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, none if it is not there."""
    files, where = _folder(spark, path)
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that readers find it whole or not at all: under another name first, then renamed."""
    files, where = _folder(spark, path)
    aside = _folder(spark, f"{path}.{uuid.uuid4().hex}.tmp")[1]
    out = files.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(where, False)
    if not files.rename(aside, where):
        raise OSError(f"{path} could not be written")


def get_text(spark: SparkSession, path: str) -> str | None:
    """What put_text wrote, None where there is no such file."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def written(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables below a folder whose writing was completed."""
    files, where = _folder(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    return [n for n in names if files.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[1])]


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing still to be computed reads, and let Spark drop shuffles no plan holds."""
    for df in tables:
        path = getattr(df, "materialized_at", None)
        if path:
            remove(df.sparkSession, path)
    if tables:
        release(tables[0].sparkSession)
    else:
        gc.collect()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffles that no plan holds any more."""
    gc.collect()
    spark._jvm.System.gc()


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of all files below a folder, 0 if it is not there."""
    files, where = _folder(spark, path)
    return files.getContentSummary(where).getLength() if files.exists(where) else 0
