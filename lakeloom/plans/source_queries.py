"""Queries of parsed documents, of learned words, and of clusters by parts."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from lakeloom.operators.dedup import agglomerate_parts
from lakeloom.operators.segmenter import learn_words, segmenter
from lakeloom.plans.registry import Tables, query
from lakeloom.plans.store_queries import fresh
from lakeloom.sources import unified as U
from lakeloom.sources.readers import archive_members


def _parsed(t: Tables):
    """Documents as a layout engine would give them: four lines a page, every fifth line an image named by its first letters."""
    d = t.documents.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    image = F.col("n") % 5 == 4
    e = F.struct(F.when(image, "image").otherwise("text").alias("type"), F.when(~image, F.col("line")).alias("text"), F.when(image, F.concat(F.lit("img-"), F.substring("line", 1, 3), F.lit("-"), F.col("n") % 4)).alias("key"))
    pages = d.groupBy("doc_id", "source", "lang", F.floor(F.col("n") / 4).alias("p")).agg(F.array_sort(F.collect_list(F.struct("n", e.alias("e")))).alias("es"))
    page = F.struct((F.col("p") + 1).alias("page"), F.transform("es", lambda x: x["e"]).alias("elements"))
    docs = pages.groupBy("doc_id", "source", "lang").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    path = fresh(t, "parsed")
    docs.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "source", F.col("lang").alias("description"), "pages")).alias("value")).write.text(path)
    return U.read_unified(t.spark, path)


_LINES = """l AS (SELECT doc_id::VARCHAR AS doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
  e AS (SELECT *, n // 4 + 1 AS page, n % 4 AS pos, n % 5 = 4 AS image, CASE WHEN n % 5 = 4 THEN 'img-' || substr(line, 1, 3) || '-' || (n % 4) END AS key FROM l)"""


@query("s7_page_elements", f"WITH {_LINES} SELECT doc_id, source, page::INTEGER AS page, pos::INTEGER AS pos, CASE WHEN image THEN 'image' ELSE 'text' END AS type, CASE WHEN NOT image THEN line END AS text, key FROM e")
def _(t: Tables):
    return U.page_elements(_parsed(t))


@query("s8_image_documents", f"""WITH {_LINES}, p AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY pos) AS text FROM e WHERE NOT image AND trim(line, ' ') <> '' GROUP BY doc_id, page),
  f AS (SELECT * FROM e WHERE image QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, page, pos) = 1),
  c AS (SELECT key, f.doc_id, source, lang || chr(10) || coalesce((SELECT string_agg(text, chr(10) ORDER BY p.page) FROM p WHERE p.doc_id = f.doc_id AND p.page BETWEEN f.page - 1 AND f.page + 1), '') AS context FROM f)
  SELECT 'image-' || sha256(key) AS doc_id, source, 1 AS page, 'Image ' || key || chr(10) || sha256(context) AS text, key FROM c""")
def _(t: Tables):
    """Images once each, described by a rule on their context, written as documents and read again."""
    docs = _parsed(t)
    c = U.image_context(docs, U.page_elements(docs))
    path = fresh(t, "images")
    U.image_documents(c, F.concat(F.lit("Image "), "key"), F.sha2("context", 256)).select("value").write.text(path)
    return U.page_elements(U.read_unified(t.spark, path)).select("doc_id", "source", "page", "text", "key")


_RUN = "[\\p{L}]+"
_UNSPACED = "regexp_replace(lower(text), '[ ]+', '', 'g')"


def _unspaced():
    return F.regexp_replace(F.lower("text"), "[ ]+", "")


@query("f1_learned_words", rf"""WITH r AS (SELECT unnest(regexp_extract_all({_UNSPACED}, '[\p{{L}}]+')) AS r FROM conversations),
  a AS (SELECT r, unnest(range(1, length(r) + 1)) AS i FROM r), b AS (SELECT r, i, unnest(range(1, least(4, length(r) - i + 1) + 1)) AS k FROM a),
  g AS (SELECT substr(r, i, k) AS gram, CASE WHEN i > 1 THEN substr(r, i - 1, 1) ELSE '' END AS lft, substr(r, i + k, 1) AS rgt FROM b),
  le AS (SELECT gram, sum(c) AS n, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS e FROM (SELECT gram, lft, count(*)::DOUBLE AS c FROM g GROUP BY ALL) GROUP BY gram),
  re AS (SELECT gram, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS e FROM (SELECT gram, rgt, count(*)::DOUBLE AS c FROM g GROUP BY ALL) GROUP BY gram),
  s AS (SELECT gram, n, least(le.e, re.e) AS e FROM le JOIN re USING (gram)), total AS (SELECT sum(n) AS total FROM s WHERE length(gram) = 1),
  w AS (SELECT gram, n, unnest(range(1, length(gram))) AS k FROM s WHERE length(gram) > 1 AND n >= 5 AND e >= 0.7),
  c AS (SELECT w.gram, w.n, min(ln(w.n) + ln(total) - ln(x.n) - ln(y.n)) AS cohesion FROM w JOIN s x ON x.gram = substr(w.gram, 1, k) JOIN s y ON y.gram = substr(w.gram, k + 1), total GROUP BY w.gram, w.n)
  SELECT gram AS word, n::BIGINT AS n, round(ln(n) - ln(total), 6) AS logp FROM (SELECT gram, n FROM s WHERE length(gram) = 1 UNION ALL SELECT gram, n FROM c WHERE cohesion >= 1.0), total""")
def _(t: Tables):
    """Words of all conversations with their spaces taken out."""
    w = learn_words(t.conversations, _unspaced(), _RUN)
    return w.select("word", "n", F.round("logp", 6).alias("logp"))


@query("f1_segments")
def _(t: Tables):
    """The same texts, cut by the words learned from them."""
    cut = segmenter(learn_words(t.conversations, _unspaced(), _RUN), r"[^\W\d_]+")
    return t.conversations.select("conv_id", "turn", cut(_unspaced()).alias("tokens"))


@query("a27_agglomerative_parts")
def _(t: Tables):
    return agglomerate_parts(t.embeddings, "label")


def _packed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Archives of up to 100 rows(doc_id, name, text), zip and compressed tar in turn, as (path, content)."""
    for pdf in it:
        for start in range(0, len(pdf), 100):
            part, out = pdf.iloc[start : start + 100], io.BytesIO()
            if part["doc_id"].iloc[0] % 2:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, text in zip(part["name"], part["text"], strict=True):
                        z.writestr(name, text)
            else:
                with tarfile.open(fileobj=out, mode="w:gz") as t:
                    for name, text in zip(part["name"], part["text"], strict=True):
                        info, blob = tarfile.TarInfo(name), text.encode()
                        info.size = len(blob)
                        t.addfile(info, io.BytesIO(blob))
            yield pd.DataFrame({"path": [f"archive of {part['doc_id'].iloc[0]}"], "content": [out.getvalue()]})


@query("s2_archives", """WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS lang, sha256(coalesce(text, '')) AS digest FROM documents)
  SELECT CASE WHEN doc_id % 9 = 4 THEN '../' ELSE '' END || lang || '/' || doc_id || '.txt' AS name, CASE WHEN doc_id % 9 <> 4 THEN digest END AS digest, CASE WHEN doc_id % 9 = 4 THEN 'outside' END AS fault FROM d""")
def _(t: Tables):
    """Documents packed into zip and tar files below the shared folder, read back; every ninth name leads out of its archive."""
    name = F.concat(F.when(F.col("doc_id") % 9 == 4, "../").otherwise(""), F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    d = t.documents.select("doc_id", name.alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    folder = fresh(t, "archives")
    d.hint("rebalance", "doc_id").mapInPandas(_packed, "path string, content binary").write.parquet(folder)
    found = archive_members(t.spark.read.parquet(folder))
    return found.select("name", F.sha2("content", 256).alias("digest"), "fault")
