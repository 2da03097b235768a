"""Documents that a layout engine has parsed: pages of elements, and the documents that images become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_unified(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(doc_id, source, description, doc variant, fault): one JSON document a line.

    A document is {"doc_id", "source", "description", "pages": [{"page", "elements": [{"type",
    "text", "key"}]}]}; what else it holds stays in doc. A line that is no JSON object has a null
    doc and is in fault; blank lines are skipped.
    """
    lines = spark.read.text(paths).where("trim(value) <> ''").select("value", F.try_parse_json("value").alias("doc"))
    doc = F.when(F.schema_of_variant("doc").startswith("OBJECT"), F.col("doc"))
    field = lambda p: F.try_variant_get(doc, f"$.{p}", "string").alias(p)
    return lines.select(field("doc_id"), field("source"), field("description"), doc.alias("doc"), F.when(doc.isNull(), F.col("value")).alias("fault"))


def page_elements(docs: DataFrame) -> DataFrame:
    """(doc_id, source, page, pos, type, text, key): an element a row, pages by their number, else by their place."""
    pages = "array<struct<page:int,elements:array<struct<type:string,text:string,key:string>>>>"
    d = docs.where("doc IS NOT NULL").select("doc_id", "source", F.posexplode(F.try_variant_get("doc", "$.pages", pages)).alias("place", "p"))
    return d.select("doc_id", "source", F.coalesce("p.page", F.col("place") + 1).alias("page"), F.posexplode("p.elements").alias("pos", "e")).select("doc_id", "source", "page", "pos", "e.type", "e.text", "e.key")


def page_texts(elements: DataFrame) -> DataFrame:
    """(doc_id, page, text): the texts of a page's elements in order, a line each; images have none."""
    t = elements.where("type <> 'image' AND coalesce(trim(text), '') <> ''")
    g = t.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return g.select("doc_id", "page", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def image_context(docs: DataFrame, elements: DataFrame, around: int = 1) -> DataFrame:
    """(key, doc_id, source, page, context): each image key once, where it comes first (by document, page, place).

    The context is the document's description and the texts of the pages from ``around`` before to
    ``around`` after; pages meet by equality, a text going to each page that it is near.
    """
    first = elements.where("type = 'image' AND coalesce(trim(key), '') <> ''").groupBy("key").agg(F.min(F.struct("doc_id", "page", "pos", "source")).alias("f")).select("key", "f.*")
    near = page_texts(elements).select("doc_id", F.explode(F.sequence(F.col("page") - around, F.col("page") + around)).alias("page"), F.struct(F.col("page").alias("n"), "text").alias("t"))
    met = first.join(near, ["doc_id", "page"], "left").groupBy("key", "doc_id", "source", "page").agg(F.array_sort(F.collect_list("t")).alias("t"))
    about = docs.where("doc IS NOT NULL").groupBy("doc_id").agg(F.min("description").alias("description"))
    met = met.join(about, "doc_id", "left")
    return met.select("key", "doc_id", "source", "page", F.concat_ws("\n", "description", F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("context"))


def image_documents(contexts: DataFrame, caption: Column, detail: Column) -> DataFrame:
    """(doc_id, value): a document of one page for each image, as the JSON line that read_unified takes.

    caption and detail are expressions on a context row, from a model or a rule; an image that
    they say nothing about has no document.
    """
    text = F.concat_ws("\n", caption, detail)
    c = contexts.withColumn("_text", text).where("trim(_text) <> ''")
    element = F.struct(F.lit("text").alias("type"), F.col("_text").alias("text"), F.col("key").alias("key"))
    name = F.concat(F.lit("image-"), F.sha2("key", 256))
    doc = F.struct(name.alias("doc_id"), F.col("source").alias("source"), F.col("doc_id").alias("parent"), caption.alias("description"), F.array(F.struct(F.lit(1).alias("page"), F.array(element).alias("elements"))).alias("pages"))
    return c.select(name.alias("doc_id"), F.to_json(doc).alias("value"))
