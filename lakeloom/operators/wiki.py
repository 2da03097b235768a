"""Wiki pages under edits: working copies, checks, promotion, rollback.

Pages are rows of a keyed table, a version for each promotion. Edits are applied page by page, in
their order, by one native fold over the page's edits; a working copy is the outcome for the
touched pages and stands beside the version it came from until it is promoted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeloom.functions.records import valid_page_path
from lakeloom.functions.text import front_matter, slugify, wiki_links
from lakeloom.session import materialize
from lakeloom.sources.keyed import KeyedTable

EDITS = "seq long, op string, path string, old string, new string"


def page_path(path: Column, content: Column) -> Column:
    """A new page's path: from the title in its front matter, else the one that was asked for."""
    title = front_matter(content, "title")
    return F.when(title.isNotNull(), F.concat(F.lit("pages/"), slugify(title), F.lit(".md"))).otherwise(path)


def occurrences(text: Column, part: Column) -> Column:
    """How often a part is in a text without overlap; an empty or null part is nowhere."""
    n = F.length(part)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / n).cast("int")).otherwise(0)


def _step(state: Column, e: Column) -> Column:
    """The page after one edit, and what is said about it."""
    page, there = state["content"], state["content"].isNotNull()
    n = occurrences(page, e["old"])
    at = F.instr(page, e["old"])
    edited = F.concat(F.substr(page, F.lit(1), at - 1), F.coalesce(e["new"], F.lit("")), F.substr(page, at + F.length(e["old"])))
    said = (
        F.when(~valid_page_path(e["path"]), "error: invalid path")
        .when((e["op"] == "create") & there, "error: already exists").when(e["op"] == "create", "ok: created")
        .when(~there, "error: does not exist")
        .when(e["op"] == "delete", "ok: deleted")
        .when(e["op"] != "edit", "error: unknown operation")
        .when(n == 0, "error: not found").when(n > 1, F.concat(F.lit("error: matches "), n.cast("string"))).otherwise("ok: edited")
    )
    said = F.coalesce(said, F.lit("error: unknown operation"))
    after = F.when(said == "ok: created", F.coalesce(e["new"], F.lit(""))).when(said == "ok: edited", edited).when(said == "ok: deleted", F.lit(None).cast("string")).otherwise(page)
    return F.struct(after.alias("content"), F.concat(state["log"], F.array(F.struct(e["seq"].alias("seq"), said.alias("result")))).alias("log"))


def apply_edits(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, before, content, log array<seq, result>) of each page that edits(seq, op, path, old, new) name.

    create makes a page that isn't there, edit replaces the one place where old is, delete removes;
    what can't be done is said and changes nothing. content is null where there is no page after all.
    """
    e = edits.withColumn("path", F.when(F.col("op") == "create", page_path(F.col("path"), F.col("new"))).otherwise(F.col("path")))
    todo = e.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "path", "old", "new"))).alias("todo"))
    rows = todo.join(pages.select("path", F.col("content").alias("before")), "path", "left")
    empty = F.array().cast("array<struct<seq:bigint,result:string>>")
    out = F.aggregate("todo", F.struct(F.col("before").alias("content"), empty.alias("log")), _step)
    return rows.select("path", "before", out.alias("out")).select("path", "before", "out.content", "out.log")


def lint(pages: DataFrame, index: str = "index.md") -> DataFrame:
    """(kind, path, target): empty pages, links to no page, pages no other page links to, pages the index leaves out."""
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    links = pages.select("path", F.explode(F.array_distinct(wiki_links(F.col("content")))).alias("link"))
    links = links.select("path", "link", slugify(F.regexp_extract("link", r"^([^|#]*)", 1)).alias("stem")).where("stem <> ''")
    stems = pages.where(F.col("path") != index).select(F.col("path").alias("page"), stem.alias("stem"))
    none = F.lit(None).cast("string")
    empty = pages.where(F.coalesce(F.btrim("content", F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == "").select(F.lit("empty").alias("kind"), "path", none.alias("target"))
    dead = links.join(stems, "stem", "left_anti").select(F.lit("dead link").alias("kind"), "path", F.col("link").alias("target"))
    met = links.join(stems, "stem").where("path <> page")
    orphans = stems.join(met.where(F.col("path") != index).select("page").distinct(), "page", "left_anti").select(F.lit("orphan").alias("kind"), F.col("page").alias("path"), none.alias("target"))
    missing = stems.join(met.where(F.col("path") == index).select("page").distinct(), "page", "left_anti").select(F.lit("not in index").alias("kind"), F.col("page").alias("path"), none.alias("target"))
    return empty.unionByName(dead).unionByName(orphans).unionByName(missing)


@dataclass
class WorkingCopy:
    """What edits make of the touched pages of a version."""

    base: int
    edits: DataFrame
    pages: DataFrame

    def results(self) -> DataFrame:
        """(seq, path, result) of every edit."""
        return self.pages.select("path", F.explode("log").alias("l")).select("l.seq", "path", "l.result")

    def faults(self) -> DataFrame:
        """Touched pages that are there and say nothing."""
        return self.pages.where((F.btrim("content", F.lit(" \t\n\x0b\x0c\r")) == "") & ~F.col("content").eqNullSafe(F.col("before"))).select("path")


class Wiki:
    """Pages of one folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark, self.table = spark, KeyedTable(spark, path, "path string, content string", ["path"], buckets)

    def pages(self, version: int | None = None) -> DataFrame:
        return self.table.read(version=version)

    def version(self) -> int:
        return max(self.table.versions(), default=0)

    def _copy(self, edits: DataFrame) -> WorkingCopy:
        base, paths = self.version(), edits.select(F.when(F.col("op") == "create", page_path(F.col("path"), F.col("new"))).otherwise(F.col("path")).alias("path")).where("path IS NOT NULL")
        return WorkingCopy(base, edits, materialize(apply_edits(self.table.lookup(paths), edits), "wiki-copy"))

    def work(self, edits: DataFrame) -> WorkingCopy:
        """A working copy; the wiki stays as it is."""
        return self._copy(materialize(edits.where("path IS NOT NULL").select("seq", "op", "path", "old", "new"), "wiki-edits"))

    def preview(self, copy: WorkingCopy) -> DataFrame:
        """All pages as they would be."""
        return self.pages(copy.base or None).join(copy.pages.select("path"), "path", "left_anti").unionByName(copy.pages.where("content IS NOT NULL").select("path", "content"))

    def promote(self, copy: WorkingCopy, tag: str | None = None, check: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """Make the working copy the wiki, whole or not at all; whether it was.

        It is refused if a touched page is empty or check(all pages as they would be) has a row.
        If others promoted something since the copy was made, its edits are applied to what is
        there now, and it is refused if one of them that was fine then no longer is. Readers see
        the old version until the new one is complete.
        """
        if self.version() != copy.base:
            now = self._copy(copy.edits)
            fine = lambda c: c.results().where("result LIKE 'ok%'").select("seq", "path")
            if not fine(copy).join(fine(now), ["seq", "path"], "left_anti").isEmpty():
                return False
            copy = now
        if not copy.faults().isEmpty() or check is not None and not check(self.preview(copy)).isEmpty():
            return False
        changed = copy.pages.where(~F.col("content").eqNullSafe(F.col("before")))
        self.table.replace(changed.select("path", "content", F.col("content").isNull().alias("gone")), tag)
        return True

    def rollback(self, version: int) -> None:
        """Make an earlier version the wiki again."""
        self.table.restore(version)


def scheduled(spark: SparkSession, job: Callable[[int], None], checkpoint: str, every: str = "1 hour") -> StreamingQuery:
    """A running stream that calls job(tick) at each processing-time trigger until it is stopped.

    Its checkpoint remembers the ticks: one that was under way when the stream ended comes again.
    """
    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    writer = source.writeStream.foreachBatch(lambda batch, tick: job(tick)).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start()
