"""Chunkers: one document to many chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.text import words
from lakeloom.operators.scans import overlapping

# Characters a window chunk may end after
PUNCTUATION = ["。", ".", ",", "，", "!", "?", "！", "？", "\n"]


def stride_chunks(docs: DataFrame, size: int = 1024, overlap: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_order_index, tokens, content): every size tokens, size - overlap apart. Tokens are words."""
    step = size - overlap
    d = docs.select(id_col, words(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).where(F.size("t") > 0)
    starts = F.sequence(F.lit(0), F.size("t") - 1, F.lit(step))
    d = d.select(id_col, "t", F.posexplode(starts).alias("chunk_order_index", "at"))
    piece = F.slice("t", F.col("at") + 1, F.lit(size))
    return d.select(id_col, "chunk_order_index", F.size(piece).alias("tokens"), F.array_join(piece, " ").alias("content"))


def delimiter_chunks(docs: DataFrame, delimiter: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_order_index, tokens, content): parts between delimiters, trimmed."""
    d = docs.select(id_col, F.posexplode(F.split(F.col(text_col), re.escape(delimiter))).alias("chunk_order_index", "part"))
    return d.select(id_col, "chunk_order_index", F.size(words(F.col("part"))).alias("tokens"), F.trim("part").alias("content"))


def window_spans(tokens: list[str], size: int, overlap: int, compat: bool = False) -> list[tuple[str, int, int]]:
    """Windows of tokens, each cut after its last punctuation mark, overlap apart: (text, first token, end).

    compat drops what the reference's rule drops: text after the final mark, and everything after
    a window that makes no progress. Otherwise the last window is whole and a window that would
    not advance is taken to its end.
    """
    out, start, total = [], 0, len(tokens)
    while start < total:
        end = min(start + size, total)
        window = "".join(tokens[start:end])
        cut = max(window.rfind(p) for p in PUNCTUATION)
        stop, taken = end, 0
        if cut > 0 and (compat or end < total):
            for k in range(start, end):
                taken += len(tokens[k])
                if taken > cut:
                    stop = k + 1
                    break
            if not compat and stop - overlap <= start:
                stop = end
        text = "".join(tokens[start:stop]).strip()
        if text:
            out.append((text, start, stop))
        if stop >= total or stop - overlap <= start:
            break
        start = stop - overlap
    return out


def window_chunks(docs: DataFrame, size: int = 1024, overlap: int = 50, compat: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_no, chunk_id, text, token_start, token_end). A token is a word with the white space after it."""
    find = re.compile(r"\S+\s*|^\s+").findall

    @F.pandas_udf("array<struct<text:string,token_start:int,token_end:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"text": x, "token_start": a, "token_end": b} for x, a, b in window_spans(find(t or ""), size, overlap, compat)])

    d = docs.select(id_col, F.posexplode(cut(F.col(text_col))).alias("chunk_no", "c"))
    return d.select(id_col, "chunk_no", F.sha2("c.text", 256).alias("chunk_id"), "c.text", "c.token_start", "c.token_end")


def interval_overlap(old: DataFrame, new: DataFrame, width: int = 64) -> DataFrame:
    """Pairs of one source whose half-open ranges overlap: old(source, old_id, s, e), new(source, new_id, s, e). They meet in bins of width."""
    o = old.select("source", "old_id", F.col("s").alias("os"), F.col("e").alias("oe"))
    return overlapping(new.select("source", "new_id", "s", "e"), o, width).select("source", "new_id", "old_id")


# Marks between sentences and clauses, the strongest first
SENTENCE_MARKS = [".", "?", "!", "。", "？", "！", ";", "；", ",", "，", ":", "：", ")", "]", "}"]


def _semantic_split(text: str, size: int) -> list[str]:
    """Parts of at most size words: split at the strongest separator there is, then merged greedily."""
    if len(text.split()) <= size:
        return [text]
    for pattern in (r"(?<=\n)(?=[^\n])", r"(?<=\t)(?=[^\t])", *[rf"(?<={re.escape(m)})(?=\s)" for m in SENTENCE_MARKS], r"(?<=\s)(?=\S)"):
        parts = re.split(pattern, text)
        if len(parts) > 1:
            out: list[str] = []
            n = 0
            for p in (q for part in parts for q in _semantic_split(part, size)):
                w = len(p.split())
                if out and n + w <= size:
                    out[-1] += p
                    n += w
                else:
                    out.append(p)
                    n = w
            return out
    return [text]


def semantic_chunks(docs: DataFrame, size: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_no, text, offset): recursive splitting at line ends, tabs, marks, then white space, merged up to size words."""

    @F.pandas_udf("array<struct<text:string,offset:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            out, at = [], 0
            for p in _semantic_split(t, size) if t else []:
                out.append({"text": p.strip(), "offset": at})
                at += len(p)
            return [c for c in out if c["text"]]

        return texts.map(one)

    d = docs.select(id_col, F.posexplode(cut(F.col(text_col))).alias("chunk_no", "c"))
    return d.select(id_col, "chunk_no", "c.text", "c.offset")


def sheet_chunks(rows: DataFrame, order: str, columns: list[str], caption: str, desc: str, chunk_rows: int = 50) -> DataFrame:
    """(chunk_no, text): Markdown tables of chunk_rows rows, the header and caption repeated.

    Row numbers come from a range sort and prefix counts of its partitions, not from one window over the table.
    """
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    d = rows.select(F.col(order).alias("o"), cells.alias("line"))
    d = numbered(d, "o")
    d = d.groupBy(F.floor((F.col("rn") - 1) / chunk_rows).alias("chunk_no")).agg(F.array_sort(F.collect_list(F.struct("rn", "line"))).alias("ls"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    title = F.when(F.col("chunk_no") == 0, F.lit(f"{caption}: {desc}")).otherwise(F.lit(f"{caption} (continued)"))
    return d.select("chunk_no", F.concat_ws("\n", title, F.lit(head), F.array_join(F.col("ls.line"), "\n")).alias("text"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with rn, 1-based, in the order of a unique numeric column: counts of ranges of 1000 first, then places inside each."""
    r = rows.withColumn("bucket", F.floor(F.col(order).cast("double") / 1000))
    sizes = r.groupBy("bucket").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("bucket").orderBy(order))
    return r.withColumn("inside", inside).join(before.select("bucket", "before"), "bucket").withColumn("rn", F.col("inside") + F.col("before")).drop("bucket", "inside", "before")


def render_conversation(turns: DataFrame) -> DataFrame:
    """(conv_id, text): role: content lines in turn order."""
    lines = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return lines.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("text"))


def content_ids(docs: DataFrame, text: Column) -> DataFrame:
    return docs.withColumn("chunk_id", F.sha2(text, 256))
