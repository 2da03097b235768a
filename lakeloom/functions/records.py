"""Records and answers in a model's replies, and texts made for it, as native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tuple_records(text: Column, record: str = "##", field: str = "<|>", complete: str = "<|COMPLETE|>") -> Column:
    """array<array<string>>: the fields of each parenthesised record of a delimited reply, outer quotes taken off.

    Pieces without parentheses are dropped; a null reply has no records.
    """
    pieces = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit(complete), F.lit("")), re.escape(record))
    inner = F.transform(pieces, lambda p: F.regexp_extract(p, r"(?s)\((.*)\)", 1))
    found = F.filter(inner, lambda p: p != "")
    return F.transform(found, lambda p: F.transform(F.split(p, re.escape(field)), lambda x: F.regexp_replace(F.trim(x), '^"|"$', "")))


def entity_records(text: Column) -> Column:
    """array<struct<name,type,description>> of the entity records that have a name and a description."""
    four = F.filter(tuple_records(text), lambda r: (F.size(r) >= 4) & (F.lower(r[0]) == "entity") & (F.trim(r[1]) != "") & (F.trim(r[3]) != ""))
    return F.transform(four, lambda r: F.struct(F.trim(r[1]).alias("name"), F.lower(r[2]).alias("type"), F.trim(r[3]).alias("description")))


def relation_records(text: Column) -> Column:
    """array<struct<source,target,keywords,description,weight>>; a weight that is no number is 1, equal ends go."""
    five = F.filter(tuple_records(text), lambda r: (F.size(r) >= 5) & (F.lower(r[0]) == "relationship") & (F.trim(r[1]) != "") & (F.trim(r[2]) != "") & (F.trim(r[1]) != F.trim(r[2])))
    weight = lambda r: F.coalesce(F.element_at(r, -1).try_cast("double"), F.lit(1.0))
    return F.transform(five, lambda r: F.struct(F.trim(r[1]).alias("source"), F.trim(r[2]).alias("target"), F.trim(r[4]).alias("keywords"), F.trim(r[3]).alias("description"), weight(r).alias("weight")))


def final_answer(text: Column) -> Column:
    """The text after the last ``Final Answer:``, else the text without blank edges; null if nothing is left."""
    after = F.regexp_extract(text, r"(?s).*Final Answer:(.*)$", 1)
    answer = F.trim(F.when(after != "", after).otherwise(text))
    return F.when(answer != "", answer)


def citation_block(numbers_and_texts: Column) -> Column:
    """``[n] text`` of array<struct<n,text>>, joined by blank lines."""
    return F.array_join(F.transform(numbers_and_texts, lambda x: F.concat(F.lit("["), x["n"].cast("string"), F.lit("] "), x["text"])), "\n\n")


def iso_time(ts: Column) -> Column:
    """ISO 8601 in UTC, to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def content_name(content: Column, extension: str) -> Column:
    """A file name from the SHA-256 of its content, equal for equal content."""
    return F.concat(F.sha2(content, 256), F.lit("." + extension))


def valid_page_path(path: Column) -> Column:
    """Whether a relative wiki path stays inside its folder and names a Markdown page."""
    return F.coalesce(path.rlike(r"^[^/\\]") & ~path.rlike(r"(^|/)\.\.?(/|$)") & path.rlike(r"[^/]\.md$") & ~path.contains("\\"), F.lit(False))


def hashed_vector(tokens: Column, dim: int) -> Column:
    """Counts of tokens by their MD5 modulo dim: the built-in embedding where no model is given."""
    slots = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int") % dim)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))


def markdown_row(*cells: Column) -> Column:
    """A table row; bars inside cells are escaped."""
    escaped = [F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *escaped), F.lit(" |"))
