"""Readers: files by type, JSON lines, sheets, archives, knowledge records."""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Kinds of files by extension
FILE_KINDS = {
    "doc": ("pdf", "doc", "docx", "ppt", "pptx"), "html": ("html", "htm"), "image": ("png", "jpg", "jpeg", "gif", "bmp", "webp"),
    "text": ("txt", "md", "markdown"), "sheet": ("csv", "xls", "xlsx", "ods"),
}


def route_files(files: DataFrame, path: str = "path", excluded: tuple[str, ...] = ()) -> DataFrame:
    """files with kind by extension; unknown kinds and excluded substrings go."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lit(None).cast("string")
    for name, exts in FILE_KINDS.items():
        kind = F.when(ext.isin(*exts), name).otherwise(kind)
    out = files.withColumn("kind", kind).where("kind IS NOT NULL")
    for x in excluded:
        out = out.where(~F.col(path).contains(x))
    return out


#: Members of archives that a task gathers before it sends them, and bytes of these.
MEMBER_ROWS, MEMBER_BYTES = 1000, 4 << 20


def archive_members(files: DataFrame) -> DataFrame:
    """(archive, name, content, fault) of zip and tar files(path, content), a row a member; folders and links give none.

    A member that would leave the archive's folder (absolute, '..', a drive letter or backslashes)
    has the fault 'outside' and no content, an encrypted or damaged one what the reader said. An
    archive that can't be read, or breaks off, has one row without a name that says so, after the
    members before the break. A task holds an archive and the members it has not sent: MEMBER_ROWS or the one that exceeds MEMBER_BYTES.
    """

    def members(blob: bytes) -> Iterator[tuple[str | None, bytes | None, str | None]]:
        def one(name: str, read: Callable[[], bytes]) -> tuple[str, bytes | None, str | None]:
            p = PurePosixPath(name)
            if p.is_absolute() or ".." in p.parts or "\\" in name or name[1:2] == ":":
                return name, None, "outside"
            try:
                return name, read(), None
            except (OSError, RuntimeError, NotImplementedError, EOFError, zipfile.BadZipFile, tarfile.TarError, zlib.error) as e:
                return name, None, f"{type(e).__name__}: {e}"

        try:
            if zipfile.is_zipfile(io.BytesIO(blob)):
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for i in z.infolist():
                        if not i.is_dir():
                            yield one(i.filename, partial(z.read, i))
            else:
                with tarfile.open(fileobj=io.BytesIO(blob)) as t:
                    for m in t:
                        if m.isfile():
                            yield one(m.name, t.extractfile(m).read)
        except (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, zlib.error) as e:
            yield None, None, f"{type(e).__name__}: {e}"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for pdf in it:
            for path, blob in zip(pdf["path"], pdf["content"], strict=True):
                for name, content, fault in members(blob if blob is not None else b""):
                    rows.append((path, name, content, fault))
                    size += len(content or b"")
                    if size > MEMBER_BYTES or len(rows) >= MEMBER_ROWS:
                        yield pd.DataFrame(rows, columns=["archive", "name", "content", "fault"])
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["archive", "name", "content", "fault"])

    return files.select("path", "content").mapInPandas(run, "archive string, name string, content binary, fault string")


def expand_archives(files: DataFrame) -> DataFrame:
    """(archive, name, content) of zip and tar files(path, content); members that leave the archive's folder are skipped, any other fault is an error."""
    fault = F.raise_error(F.concat_ws(": ", "archive", "name", "fault")).cast("boolean")
    good = F.when(F.col("fault").isNull(), True).when(F.col("fault") == "outside", False).otherwise(fault)
    return archive_members(files).where(good).select("archive", "name", "content")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a schema; malformed and blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source, pages): each text or Markdown file as a document of one page with its merged text."""
    t = spark.read.text(path, wholetext=True).withColumn("source", F.element_at(F.split(F.input_file_name(), "/"), -1))
    page = F.array(F.struct(F.lit("0").alias("id"), F.lit("merge_text").alias("type"), F.col("value").alias("text")))
    return t.select("source", F.create_map(F.lit("page_0"), page).alias("pages"))


def page_texts(docs: DataFrame) -> DataFrame:
    """(source, page, text): the last element of every page from page_0 on up to the first gap, line ends as commas."""
    d = docs.select("source", F.expr("filter(sequence(0, size(pages)), n -> try_element_at(pages, concat('page_', n)) IS NULL)[0]").alias("n"), "pages")
    d = d.where("n > 0").select("source", F.explode(F.expr("sequence(0, n - 1)")).alias("page"), "pages")
    text = F.expr("element_at(try_element_at(pages, concat('page_', page)), -1).text")
    return d.select("source", "page", F.replace(text, F.lit("\n"), F.lit(",")).alias("text"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV as text columns: bad lines skipped, missing cells blank."""
    return spark.read.csv(path, header=True, inferSchema=False, mode="DROPMALFORMED").na.fill("")


def unify_keys(records: DataFrame) -> DataFrame:
    """Spellings of id and chunk_id as one column each."""
    names = {c.lower(): [] for c in records.columns}
    for c in records.columns:
        names[c.lower()].append(c)
    ids, chunks = names.get("id", []), [*names.get("chunk_id", []), *names.get("chunkid", [])]
    rest = [c for c in records.columns if c not in (*ids, *chunks)]
    one = lambda cs, to: [F.coalesce(*[F.col(f"`{c}`") for c in cs]).alias(to)] if cs else []
    return records.select(*one(ids, "Id"), *one(chunks, "chunk_id"), *rest)


def source_mapping(records: DataFrame) -> DataFrame:
    """(source, chunk_ids) of records(file, line, source, chunk_id) in line order; a missing source is file-line."""
    r = records.where("chunk_id IS NOT NULL").withColumn("source", F.coalesce("source", F.concat_ws("-", "file", "line")))
    g = r.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("file", "line", "chunk_id"))).alias("c"))
    return g.select("source", F.transform("c", lambda x: x["chunk_id"]).alias("chunk_ids"))


def fill_down_taxonomy(rows: DataFrame, order: str, levels: list[str]) -> DataFrame:
    """Blank cells of the upper levels take the value above; rows blank in every level go."""
    blank = F.lit(True)
    for c in levels:
        blank = blank & (F.coalesce(F.trim(F.col(c)), F.lit("")) == "")
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    filled = rows.where(~blank)
    return filled.withColumns({c: F.last(F.when(F.trim(F.col(c)) != "", F.col(c)), ignorenulls=True).over(w) for c in levels[:-1]})
