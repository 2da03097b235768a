"""A corpus in five stages: toxic documents go, near copies go, secrets are masked, sources are mixed, texts are tokenized."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import bpe, mixing, ngram_join, secrets, toxicity
from lakeloom.llm.common import GAP, table
from lakeloom.session import materialize


def _columns(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of docs out of the struct row, some of them changed; where n_chars has no new value, the old one stays."""
    if "n_chars" in changed:
        changed["n_chars"] = F.coalesce(changed["n_chars"], F.col("row.n_chars")) if "n_chars" in docs.columns else None
    return [changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on this corpus's labels, doesn't call toxic.

    Null and empty texts are judged as texts without terms, which are not toxic; equal rows are
    judged alike. An empty table gives no rows. Columns keep their names, order and values.
    """
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, chain, with_row=True).where("kept").select(_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that Jaccard links join, the document of least doc_id. Rows without an id stay; rows of one id are one document.

    Null, empty and blank texts have no shingles and stay. An empty table gives no rows.
    """
    joined = ngram_join.ngram_join(docs)
    copies = joined.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies.hint("shuffle_hash"), "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets in its text replaced by a mark and n_chars counted anew where that changed it.

    A null text stays null, an empty one empty; repeated rows are masked alike; an empty table gives no rows.
    """
    found = secrets.scan_secrets(docs, with_row=True)
    found = found.select("row", F.concat("found", "added").alias("spans"))
    masked = found.select("row", secrets.redact("row.text", "spans").alias("masked"), (F.size("spans") > 0).alias("hit"))
    return masked.select(_columns(docs, text=F.col("masked"), n_chars=F.when(F.col("hit"), F.length("masked").cast("long"))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document is there once for each epoch that takes it; at a source's cut it ends with the last word taken.

    What the mix takes nothing of goes, but documents without words, which cost no budget, stay once.
    Rows of one id share what is taken of the largest; null ids are one id, null texts stay null,
    a null source is a source of its own. An empty table gives no rows.
    """
    mixed = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias("id")).agg(F.max("size").alias("size"), F.max("taken").alias("taken"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(mixed.hint("shuffle_hash"), F.col("row.doc_id").eqNullSafe(F.col("id")))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("long"))
    rows = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rows = rows.withColumn("left", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    gap = GAP[1:-2]
    ends = F.split("row.text", rf"(?<=[^{gap}])(?=[{gap}])", -1)  # each piece ends with a word
    cut = F.array_join(F.slice(ends, F.lit(1), F.col("left").cast("int")), "")
    whole = F.col("size") <= F.col("left")
    rows = rows.select("row", "left", F.when(whole, F.col("row.text")).otherwise(cut).alias("part"), whole.alias("whole"))
    return rows.select(_columns(docs, text=F.col("part"), n_chars=F.when(~F.col("whole"), F.length("part").cast("long"))))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the bytes that they decode to.

    A null text has no tokens, as an empty one. Rows stay as many as they were; an empty table gives no rows.
    """
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN, decoded=False, keep=["source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]
#: SQL can't express the classifier, the join's components or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
