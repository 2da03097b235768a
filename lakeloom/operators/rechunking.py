"""Chunks cut anew over the joined text of each source, whatever rows that text lies in.

A window's end depends on the marks in it, and the next window on that end, so windows of a source
form one long chain. Where a chain enters a block of tokens decides where it leaves it. For each
block the exits of all possible entries are found at once; the exits of many blocks are composed
level by level to those of a whole source, and the true entries come back down. Then all blocks
cut their windows at the same time, however much of the table one source holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.chunking import PUNCTUATION
from lakeloom.operators.scans import overlapping, prefix_sums
from lakeloom.session import materialize

GAP = r"\x20\x09-\x0D"
#: A token is a word with the space after it; space before the first word is one too.
TOKEN = rf"[^{GAP}]+[{GAP}]*|^[{GAP}]+"
#: Bins of a block, and blocks whose exits one step composes.
BLOCK_BINS, FAN = 16, 256
#: Tokens of a bin; never less than a window.
BIN_TOKENS = 4096


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))


class Cutter:
    """The rule of one step: windows of size tokens, cut after their last mark, overlap apart."""

    def __init__(self, size: int, overlap: int, block: int) -> None:
        if not 0 <= overlap < size:
            raise ValueError("overlap must be less than size")
        self.size, self.overlap, self.block = size, overlap, block

    def stops(self, first: int, total: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start in the block at first the window's end and the next start (-1 after the last window)."""
        n = min(self.block, total - first)
        last = np.full(n + self.size, -1, np.int64)  # place of the last mark up to each token
        own = marks[(marks >= first) & (marks < first + len(last))] - first
        last[own] = own
        last = np.maximum.accumulate(last)
        start = np.arange(n)
        end = np.minimum(start + self.size, total - first)
        cut = last[end - 1] + 1
        inner = end + first < total
        stop = np.where(inner & (cut > start) & (cut - self.overlap > start), cut, end)
        return stop, np.where(inner, stop - self.overlap, -1)

    def exits(self, first: int, total: int, marks: np.ndarray) -> np.ndarray:
        """For each entry (the block's first size tokens) where the chain enters the next block, or -1 if it ends before."""
        _, step = self.stops(first, total, marks)
        at = np.where(np.arange(self.size) < len(step), np.arange(self.size), -1)
        while True:
            inside = (at >= 0) & (at < len(step))
            if not inside.any():
                return np.where(at >= 0, at - self.block, -1)
            at[inside] = step[at[inside]]

    def windows(self, first: int, total: int, marks: np.ndarray, entry: int) -> list[tuple[int, int]]:
        stop, step = self.stops(first, total, marks)
        out, at = [], entry
        while 0 <= at < len(stop):
            out.append((first + at, first + int(stop[at])))
            at = int(step[at])
        return out


def _chain(exits: DataFrame, size: int) -> DataFrame:
    """(source, block, entry) of exits(source, block, blocks, exits): where each block is entered, -1 if it is not."""

    def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.arange(size)
        for e in pdf.sort_values("block")["exits"]:
            at = np.where(at >= 0, np.asarray(e)[at], -1)
        return pd.DataFrame({"source": [key[0]], "block": [key[1]], "blocks": [-(-int(pdf["blocks"].iloc[0]) // FAN)], "exits": [at]})

    def enter(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, at, out = left.sort_values("block"), int(right["entry"].iloc[0]), []
        for e in left["exits"]:
            out.append(at)
            at = int(e[at]) if at >= 0 else -1
        return pd.DataFrame({"source": left["source"], "block": left["block"], "entry": out})

    above = F.floor(F.col("block") / FAN).cast("long")
    levels = [exits]
    while levels[-1].agg(F.max("blocks")).first()[0] > 1:
        up = levels[-1].withColumn("up", above).groupBy("source", "up").applyInPandas(compose, "source string, block long, blocks long, exits array<long>")
        levels.append(materialize(up, "exits"))
    entries = levels[-1].select("source", "block", F.lit(0).cast("long").alias("entry"))
    for low in levels[-2::-1]:
        right = entries.withColumn("up", F.col("block")).groupBy("source", "up")
        entries = materialize(low.withColumn("up", above).groupBy("source", "up").cogroup(right).applyInPandas(enter, "source string, block long, entry long"), "entries")
    return entries


def rechunk(chunks: DataFrame, size: int = 1024, overlap: int = 50, marks: list[str] | None = None) -> DataFrame:
    """(source, token_start, token_end, chunk_id, text, source_chunk) of chunks(source, ord, chunk_id, text, source_chunk).

    The tokens of a source's chunks, by ord (ties by chunk_id), are one stream, cut into windows of
    size tokens that end after their last mark (if that gets ahead) and lie overlap tokens apart.
    source_chunk holds the sorted distinct sources of all chunks whose ranges a window overlaps; a
    null one stands for the chunk itself. Chunks without tokens take no part; a null source is one
    source; windows of spaces alone are left out; an empty table gives no rows.
    """
    width = max(BIN_TOKENS, size)
    cutter = Cutter(size, overlap, width * BLOCK_BINS)
    own = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    c = chunks.select(own.alias("source"), "ord", F.col("chunk_id").cast("string").alias("cid"), tokens(F.col("text")).alias("toks"), F.col("source_chunk").cast("array<string>").alias("from"))
    c = c.where(F.size("toks") > 0).select("*", F.size("toks").cast("long").alias("n"), F.monotonically_increasing_id().alias("seq"))
    c = materialize(c, "tokens")
    out_kind = chunks.schema["source"].dataType.simpleString()
    if c.isEmpty():
        return chunks.sparkSession.createDataFrame([], f"source {out_kind}, token_start long, token_end long, chunk_id string, text string, source_chunk array<string>")
    places = prefix_sums(c.select("source", "ord", "cid", "seq", "n"), "source", ["ord", "cid", "seq"], F.col("n")).select("seq", "before", "total")

    pieces = c.join(places, "seq").withColumn("bin", F.explode(F.sequence(F.floor(F.col("before") / width), F.floor((F.col("before") + F.col("n") - 1) / width))))
    pieces = pieces.withColumn("os", F.greatest("before", F.col("bin") * width)).withColumn("oe", F.least(F.col("before") + F.col("n"), (F.col("bin") + 1) * width))
    part = F.slice("toks", (F.col("os") - F.col("before") + 1).cast("int"), (F.col("oe") - F.col("os")).cast("int"))
    pieces = pieces.select("source", "bin", "os", "oe", "total", part.alias("toks"), F.coalesce("from", F.array("cid")).alias("from"))
    pieces = materialize(pieces, "pieces")

    literal = "[" + "".join("\\" + m if m in "[]^-\\" else m for m in (marks or PUNCTUATION)) + "]"
    place = F.filter(F.transform("toks", lambda t, i: F.when(t.rlike(literal), F.col("os") + i)), lambda p: p.isNotNull())
    marked = pieces.select("source", "total", F.explode(F.array_distinct(F.array(F.floor(F.col("bin") / BLOCK_BINS), F.floor((F.col("bin") - 1) / BLOCK_BINS)))).alias("block"), place.alias("marks"))
    marked = marked.where("block >= 0")  # a block sees the first bin of the next one, where its last windows may end

    def exits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total, first = int(pdf["total"].iloc[0]), int(key[1]) * cutter.block
        found = cutter.exits(first, total, np.concatenate([np.asarray(m, np.int64) for m in pdf["marks"]]))
        return pd.DataFrame({"source": [key[0]], "block": [key[1]], "blocks": [-(-total // cutter.block)], "exits": [found]})

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        first = int(left["block"].iloc[0]) * cutter.block
        found = cutter.windows(first, int(left["total"].iloc[0]), np.concatenate([np.asarray(m, np.int64) for m in left["marks"]]), int(right["entry"].iloc[0]))
        return pd.DataFrame({"source": left["source"].iloc[0], "s": [a for a, _ in found], "e": [b for _, b in found]})

    entries = _chain(materialize(marked.groupBy("source", "block").applyInPandas(exits, "source string, block long, blocks long, exits array<long>"), "exits"), size)
    windows = marked.groupBy("source", "block").cogroup(entries.groupBy("source", "block")).applyInPandas(cut, "source string, s long, e long")

    met = overlapping(windows, pieces.select("source", "os", "oe", "toks", "from"), width)
    text = F.array_join(F.slice("toks", (F.greatest("s", "os") - F.col("os") + 1).cast("int"), (F.least("e", "oe") - F.greatest("s", "os")).cast("int")), "")
    parts = met.select("source", "s", "e", F.struct(F.col("os").alias("at"), text.alias("text"), F.col("from").alias("from")).alias("part"))
    whole = parts.groupBy("source", "s", "e").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    body = F.btrim(F.array_join(F.transform("parts", lambda p: p["text"]), ""), F.lit(" \t\n\x0b\x0c\r"))
    out = whole.select("source", F.col("s").alias("token_start"), F.col("e").alias("token_end"), body.alias("text"), F.array_sort(F.array_distinct(F.flatten(F.transform("parts", lambda p: p["from"])))).alias("source_chunk"))
    name = F.when(F.col("source") != "", F.expr("substring(source, 2)")).cast(out_kind)
    return out.where("text <> ''").select(name.alias("source"), "token_start", "token_end", F.sha2("text", 256).alias("chunk_id"), "text", "source_chunk")


def rechunk_sql(size: int, overlap: int) -> str:
    """For DuckDB: documents as chunks of their sources, with the number of source chunks and their digest."""
    stop = f"CASE WHEN k.prev >= w.s AND k.prev + 1 - {overlap} > w.s THEN k.prev + 1 ELSE w.s + {size} END"
    marks = "[" + "".join(PUNCTUATION).replace("\n", "\\n") + "]"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""WITH RECURSIVE c AS (SELECT coalesce('=' || source, '') AS src, doc_id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS toks FROM documents),
  o AS (SELECT *, sum(len(toks)) OVER (PARTITION BY src ORDER BY doc_id) - len(toks) AS os FROM c WHERE len(toks) > 0),
  t AS (SELECT src, doc_id, (os + n - 1)::BIGINT AS place, toks[n] AS tok FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS n FROM o)),
  k AS (SELECT *, max(CASE WHEN regexp_matches(tok, '{marks}') THEN place END) OVER (PARTITION BY src ORDER BY place ROWS UNBOUNDED PRECEDING) AS prev FROM t),
  total AS (SELECT src, count(*) AS total FROM t GROUP BY src),
  w(src, s) AS (SELECT src, 0::BIGINT FROM total UNION ALL
    SELECT w.src, {stop} - {overlap} FROM w JOIN total USING (src) JOIN k ON k.src = w.src AND k.place = w.s + {size} - 1 WHERE w.s + {size} < total),
  win AS (SELECT w.src, w.s, CASE WHEN w.s + {size} >= total THEN total ELSE {stop} END AS e FROM w JOIN total USING (src) LEFT JOIN k ON k.src = w.src AND k.place = w.s + {size} - 1),
  body AS (SELECT w.src, w.s, w.e, trim(string_agg(tok, '' ORDER BY place), {blanks}) AS text, list_sort(list(DISTINCT doc_id::VARCHAR)) AS ids
    FROM win w JOIN t ON t.src = w.src AND t.place >= w.s AND t.place < w.e GROUP BY w.src, w.s, w.e)
SELECT CASE WHEN src <> '' THEN src[2:] END AS source, s AS token_start, e AS token_end, sha256(text) AS chunk_id, len(ids) AS n_sources, sha256(array_to_string(ids, ',')) AS sources_sha256
FROM body WHERE text <> ''"""
