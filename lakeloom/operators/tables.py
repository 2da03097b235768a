"""Generated tables: task grid, answers, pivot, typed load, and the guard of ad-hoc SQL."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_WRITES = re.compile(r"\b(insert|update|delete|drop|create|alter|truncate|merge|grant)\b", re.I)


def task_grid(entities: DataFrame, periods: DataFrame, metrics: DataFrame) -> DataFrame:
    """(task_id, entity, time, metric): every combination of (pos, entity), (pos, time), (pos, metric), densely numbered.

    The number is computed from positions and counts, so no global sort or window is needed.
    """
    sizes = periods.agg(F.count("*").alias("nt")).crossJoin(metrics.agg(F.count("*").alias("nm")))
    g = entities.select(F.col("pos").alias("pe"), "entity").crossJoin(F.broadcast(periods.select(F.col("pos").alias("pt"), "time")))  # the schema's periods
    g = g.crossJoin(F.broadcast(metrics.select(F.col("pos").alias("pm"), "metric"))).crossJoin(F.broadcast(sizes))  # and columns
    return g.select(((F.col("pe") * F.col("nt") + F.col("pt")) * F.col("nm") + F.col("pm")).alias("task_id"), "entity", "time", "metric")


def fill_answers(grid: DataFrame, answers: DataFrame) -> DataFrame:
    """Left join of answers on entity, metric and the null-safe period; missing ones are blank."""
    a = answers.select(F.col("entity").alias("e"), F.col("time").alias("t"), F.col("metric").alias("m"), "answer")
    on = (F.col("entity") == F.col("e")) & F.col("time").eqNullSafe(F.col("t")) & (F.col("metric") == F.col("m"))
    return grid.join(a, on, "left").select("task_id", "entity", "time", "metric", F.coalesce("answer", F.lit("")).alias("answer"))


def pivot_answers(filled: DataFrame, metrics: list[str]) -> DataFrame:
    """One row for each entity and period, one column for each metric, blank where there is no answer."""
    p = filled.groupBy("entity", "time").pivot("metric", metrics).agg(F.max_by("answer", "task_id"))
    return p.na.fill("", metrics)


def typed_table(df: DataFrame, numbers: list[str]) -> DataFrame:
    """Blank cells as null, number columns as DECIMAL(28,6); what is no number becomes null."""
    cells = [F.when(F.trim(F.col(c)) != "", F.col(c)) for c in df.columns]
    return df.select(*[(x.try_cast("decimal(28,6)") if c in numbers else x).alias(c) for x, c in zip(cells, df.columns, strict=True)])


def read_only(sql: str) -> bool:
    """One SELECT, or WITH ... SELECT, without a writing keyword; names such as created_at are no keyword."""
    body = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";")
    return bool(re.match(r"(select|with)\b", body, re.I)) and ";" not in body and not _WRITES.search(body)


def read_only_column(sql: Column) -> Column:
    """read_only for a column of statements, as one expression; a quote doubled inside quotes is two strings side by side."""
    body = F.regexp_replace(sql, r"(?s)'[^']*+'|\"[^\"]*+\"|--[^\n]*+|/\*.*?\*/", " ")
    body = F.regexp_replace(F.btrim(body, F.lit(" \t\n\x0b\x0c\r")), r";+$", "")
    return F.coalesce(body.rlike(r"(?i)^(select|with)\b") & ~body.contains(";") & ~body.rlike(f"(?i){_WRITES.pattern}"), F.lit(False))


def guarded_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """spark.sql with {name} placeholders for tables, after the guard."""
    if not read_only(sql):
        raise ValueError("only a single SELECT is allowed")
    return spark.sql(sql, **tables)


def fan_out(spark: SparkSession, sql: str, tables: dict[str, DataFrame | None]) -> DataFrame:
    """The rows of one guarded statement with a {table} placeholder over each table, with its name; tables that fail are left out."""
    every = None
    for name, table in tables.items():
        try:
            one = guarded_sql(spark, sql, table=table).select(F.lit(name).alias("name"), "*")
        except (ValueError, TypeError, AnalysisException, ParseException):
            continue
        every = one if every is None else every.unionByName(one)
    if every is None:
        raise ValueError("the statement failed on every table")
    return every


def describe_sheet(df: DataFrame, order: str, rows: int = 3) -> DataFrame:
    """(name, kind, samples): each column's type and its values in the first rows by order."""
    first = df.orderBy(order).limit(rows).agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*df.columns).alias("row")))).alias("r"))  # a few rows
    cells = [F.struct(F.lit(c).alias("name"), F.lit(k).alias("kind"), F.expr(f"transform(r, x -> CAST(x.row.`{c}` AS string))").alias("samples")) for c, k in df.dtypes]
    return first.select(F.inline(F.array(*cells)))


def ddl(df: DataFrame, name: str) -> str:
    """CREATE TABLE with the types that the table is loaded with."""
    kinds = {"decimal(28,6)": "DECIMAL(28,6)", "double": "DOUBLE", "bigint": "BIGINT", "int": "INT"}
    cols = ",\n  ".join(f"`{c}` {kinds.get(t, 'STRING')}" for c, t in df.dtypes)
    return f"CREATE TABLE `{name}` (\n  {cols}\n)"


def fill_down(rows: DataFrame, order: str, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """Blank cells take the last value above; runs inside each group, or over the whole table if it has none."""
    w = (W.partitionBy(*group) if group else W.partitionBy()).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(F.when(F.col(c) != "", F.col(c)), ignorenulls=True).over(w) for c in columns})
