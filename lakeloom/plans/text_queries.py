"""Queries of text functions, chunkers, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import numbers as N
from lakeloom.functions import text as T
from lakeloom.operators import chunking as C
from lakeloom.plans.registry import Tables, query
from lakeloom.sources import html as H
from lakeloom.sources import readers, writers

_D = "SELECT doc_id, {} FROM documents"
_WORDS = r"list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"


def _docs(name: str, sql: str, column) -> None:
    """A query of one expression over documents."""
    query(name, _D.format(sql))(lambda t: t.documents.select("doc_id", *column()))


_docs("f1_words", f"len({_WORDS}) AS n", lambda: [F.size(T.words(F.col("text"))).alias("n")])
_docs("f2_clean", "substr(coalesce(text, ''), 1, 80) AS t", lambda: [T.clean(F.col("text"), 80).alias("t")])
_docs("f5_sanitize", r"trim(regexp_replace(trim(text, ' '), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), ' ') AS t", lambda: [T.sanitize(F.col("text")).alias("t")])
_docs("f6_split_markers", r"list_filter(list_transform(string_split_regex(text, '\. |, '), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts", lambda: [T.split_markers(F.col("text"), [". ", ", "]).alias("parts")])
_docs("f7_preview", "CASE WHEN length(text) <= 250 THEN text ELSE substr(text, 1, 250) || '...' END AS p", lambda: [T.preview(F.col("text")).alias("p")])
_docs("f8_is_float", "regexp_matches(text, '^[-+]?[0-9]*\\.?[0-9]+$') AS f", lambda: [T.is_float(F.col("text")).alias("f")])
_docs("f8_is_float_whole", "regexp_matches(text, '^[-+]?[0-9]*\\.?[0-9]+$') AS f", lambda: [T.is_float(F.col("text")).alias("f")])
_docs("f9_has_cjk", "regexp_matches(text, '[一-鿿]') AS c", lambda: [T.has_cjk(F.col("text")).alias("c")])
_docs("f10_token_estimate", "floor(0 / 1.5 + length(text) / 4::DOUBLE)::INTEGER AS n", lambda: [T.estimate_tokens(F.col("text")).alias("n")])
_docs("f13_identifier", "CASE WHEN regexp_matches(x, '^[0-9]') THEN '_' || x ELSE x END AS name FROM (SELECT doc_id, regexp_replace(lower(trim(source || ' ' || lang, ' ')), '[^a-z0-9_]+', '_', 'g') AS x FROM documents) --", lambda: [T.identifier(F.concat_ws(" ", "source", "lang")).alias("name")])
_docs("f15_entity_key", "replace(lower(source || ' ' || lang), ' ', '_') AS k", lambda: [T.entity_key(F.concat_ws(" ", "source", "lang")).alias("k")])
_docs("f43_array_distinct", f"len(list_distinct({_WORDS})) AS n", lambda: [F.size(F.array_distinct(T.words(F.col("text")))).alias("n")])
_docs("id_sha256", "sha256(text) AS chunk_id, substr(sha256(text), 1, 32) AS node_id, 'doc-' || md5(text) AS doc_key", lambda: [F.sha2("text", 256).alias("chunk_id"), T.sha32(F.col("text")).alias("node_id"), F.concat(F.lit("doc-"), F.md5("text")).alias("doc_key")])
_docs("c4_chunk_records", "sha256(text) AS chunk_id, source, 0 AS page", lambda: [F.sha2("text", 256).alias("chunk_id"), F.col("source"), F.lit(0).alias("page")])
_docs("m14_code_fence", "CASE WHEN regexp_extract('```json' || chr(10) || lang || '```', '(?s)```(?:json|sql)?\\s*(.*?)```', 1) <> '' THEN lang END AS body", lambda: [T.strip_reply(F.concat(F.lit("<think>x</think>```json\n"), "lang", F.lit("```"))).alias("body")])
_docs("f47_outer_array", "'[' || lang || ', [' || source || ']]' AS a", lambda: [T.outer_array(F.concat(F.lit("reply: ["), "lang", F.lit(", ["), "source", F.lit("]] done"))).alias("a")])
_docs("f24_id_list", "[lang, source] AS ids", lambda: [T.id_list(F.concat(F.lit("['"), "lang", F.lit("', \""), "source", F.lit('"]'))).alias("ids")])
_docs("f23_node_pair", "lang AS a, source AS b", lambda: [T.node_pair(F.concat("lang", F.lit("||"), "source"))["a"].alias("a"), T.node_pair(F.concat(F.lit("('"), "lang", F.lit("', '"), "source", F.lit("')")))["b"].alias("b")])
_docs("f49_cache_key", "'local:extract:' || md5(text) AS k, 'extract' AS kind", lambda: [F.concat_ws(":", F.lit("local"), F.lit("extract"), F.md5("text")).alias("k"), F.split(F.concat_ws(":", F.lit("local"), F.lit("extract"), F.md5("text")), ":", 3)[1].alias("kind")])
_docs("f50_attr_json", "lang AS back", lambda: [F.from_json(F.to_json(F.create_map(F.lit("lang"), F.col("lang"))), "map<string,string>")["lang"].alias("back")])
_docs("f44_path_prefixes", "[lang, lang || ' -> ' || source, lang || ' -> ' || source || ' -> d'] AS paths", lambda: [F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.array_join(F.slice(F.array("lang", "source", F.lit("d")), F.lit(1), i), " -> ")).alias("paths")])


@query("f48_schema_map", "SELECT lang, list_sort(list_distinct(list(source))) AS sources FROM documents GROUP BY lang")
def _(t: Tables):
    return t.documents.groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))


@query("f46_node_count", "SELECT count(DISTINCT name) AS node_count, (SELECT count(DISTINCT lang || '/' || source) FROM documents) AS path_count FROM (SELECT lang AS name FROM documents UNION ALL SELECT source FROM documents)")
def _(t: Tables):
    names = t.documents.select(F.explode(F.array("lang", "source")).alias("name")).agg(F.count_distinct("name").alias("node_count"))
    return names.crossJoin(F.broadcast(t.documents.agg(F.count_distinct(F.concat_ws("/", "lang", "source")).alias("path_count"))))


def _over(name: str, table: str, key: str, sql: str, column) -> None:
    """A query of one expression over a table, with the table's key."""
    query(name, f"SELECT {key}, {sql} AS out FROM {table}")(lambda t: getattr(t, table).select(key, column().alias("out")))


def _text(*parts):
    """Columns by name; what starts with ' is a literal."""
    return F.concat(*[F.lit(p[1:]) if p.startswith("'") else F.col(p).cast("string") for p in parts])


_UNIT_CASES = [("百万", 1e6), ("亿", 1e8), (" million", 1e6), ("B", 1e9), ("k", 1e3), (" 万亿", 1e12)]
_REPLACED = "p_brand || '/' || p_type || ' (' || p_size || ')...' || p_name || '？'"
for _old, _new in T.RELATION_NAMES:
    _REPLACED = f"replace({_REPLACED}, '{_old.replace(chr(39), chr(39) * 2)}', '{_new}')"
_CLEAN = "html"
for _old, _new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _CLEAN = f"replace({_CLEAN}, '{_old}', '{_new}')"
_SLUG = "regexp_replace(substr(text, 1, 60), '[^\\p{L}\\p{N}\\-_ ]', '', 'g')"
_SLUG = f"regexp_replace(trim(regexp_replace(trim({_SLUG}, ' '), ' +', '-', 'g'), '-'), '-{{2,}}', '-', 'g')"

_over("f3_clean_memory", "pages", "page_id", rf"md5(regexp_replace(trim({_CLEAN}, ' '), '[\x00-\x1f\x7f-\x9f]', '', 'g'))", lambda: F.md5(T.clean_memory(F.col("html"))))
_over("f4_normalize", "documents", "doc_id", "'中文(' || source || ') - ' || lang || '-' || doc_id", lambda: T.normalize_extracted(_text("'\"中 文 （", "source", "'） — ", "lang", "'－", "doc_id", "'\""), True))
_over("f11_slugify", "documents", "doc_id", f"CASE WHEN {_SLUG} = '' THEN 'page' ELSE {_SLUG} END", lambda: T.slugify(F.substring("text", 1, 60)))
_over("f14_relation", "part", "p_partkey", f"trim(regexp_replace({_REPLACED}, '_+', '_', 'g'), '_')", lambda: T.sanitize_relation(_text("p_brand", "'/", "p_type", "' (", "p_size", "')...", "p_name", "'？")))
_over("f12_front_matter", "documents", "doc_id", "CASE WHEN doc_id % 3 > 0 THEN source || ' ' || doc_id END", lambda: T.front_matter(F.when(F.col("doc_id") % 3 > 0, _text("'---\ntags: x\ntitle: ", "source", "' ", "doc_id", "'\n---\n", "text")).otherwise(_text("'title: no\n---\n", "text")), "title"))
_over("f12_wiki_links", "documents", "doc_id", r"regexp_extract_all('[[' || source || ']] ' || replace(text, ' the ', ' [[the|x]] ') || ' [[]] [[' || lang || ' y]]', '\[\[([^\]]+)\]\]', 1)", lambda: T.wiki_links(F.concat(F.lit("[["), F.col("source"), F.lit("]] "), F.replace("text", F.lit(" the "), F.lit(" [[the|x]] ")), F.lit(" [[]] [["), F.col("lang"), F.lit(" y]]"))))
_over("f36_number", "part", "p_partkey", "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN p_size * {f!r}::DOUBLE" for i, (_, f) in enumerate(_UNIT_CASES)) + " WHEN 6 THEN p_partkey * 1000::DOUBLE END", lambda: N.to_number(
    F.when(F.col("p_partkey") % 8 < 6, F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*[F.lit(u) for u, _ in _UNIT_CASES]), (F.least(F.col("p_partkey") % 8, F.lit(5)) + 1).cast("int")))).when(F.col("p_partkey") % 8 == 6, _text("p_partkey", "',000")).otherwise(F.col("p_name"))))
_CAP = "(floor(o_totalprice) * 10 + 1) * pow(10, o_orderkey % 9)"
_over("f37_market_cap", "orders", "o_orderkey", f"CASE WHEN {_CAP} >= 1e12 THEN printf('%.2f', {_CAP} / 1e12) || ' 万亿美元' WHEN {_CAP} >= 1e8 THEN printf('%.2f', {_CAP} / 1e8) || ' 亿美元' WHEN {_CAP} >= 1e6 THEN printf('%.2f', {_CAP} / 1e6) || ' 百万美元' ELSE printf('%.2f', {_CAP}) || ' 美元' END", lambda: N.format_market_cap((F.floor("o_totalprice") * 10 + 1) * F.pow(F.lit(10.0), F.col("o_orderkey") % 9)))
_over("f1_mixed_tokens", "documents", "doc_id", f"'世界|界你|你好|' || array_to_string({_WORDS}, '|') || '|' || source || '|中'", lambda: F.array_join(T.mixed_tokens(_text("'世界你好", "text", "' ", "source", "'中")), "|"))


@query("f36_number_parts", "SELECT p_partkey, p_size * 1000000.0::DOUBLE AS num FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", N.convert_number(F.concat(F.col("p_size").cast("string"), F.lit(" Million")))["num"].alias("num"))


@query("f40_periods", """SELECT c, (n // 4)::VARCHAR || ' Q' || (n % 4 + 1)::VARCHAR AS period FROM (SELECT c, unnest(range(a, b + 1)) AS n FROM (
  SELECT o_custkey AS c, min(year(o_orderdate) * 4 + quarter(o_orderdate) - 1) AS a, max(year(o_orderdate) * 4 + quarter(o_orderdate) - 1) AS b FROM orders GROUP BY 1))""")
def _(t: Tables):
    """The quarters from each customer's first order to the last."""
    span = t.orders.groupBy(F.col("o_custkey").alias("c")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return span.select("c", F.explode(N.quarters(F.year("a"), F.year("b"), F.quarter("a"), F.quarter("b"))).alias("period"))


@query("f41_epoch", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.date_format(F.timestamp_seconds(F.unix_timestamp("ts")), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


_STRIDE = f"""t AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 896)) AS p FROM t WHERE len(w) > 0)"""


@query("c6_stride_chunks", f"WITH {_STRIDE} SELECT doc_id, (p // 896)::INTEGER AS chunk_order_index, len(w[p + 1 : p + 1024]) AS tokens, array_to_string(w[p + 1 : p + 1024], ' ') AS content FROM s")
def _(t: Tables):
    return C.stride_chunks(t.documents)


@query("c6_delimiter_chunks", f"""SELECT doc_id, (generate_subscripts(p, 1) - 1)::INTEGER AS chunk_order_index, unnest(list_transform(p, lambda x: len(list_filter(string_split_regex(x, '[ \\t\\n\\x0B\\f\\r]+'), lambda y: y <> '')))) AS tokens,
  unnest(list_transform(p, lambda x: trim(x, ' '))) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)""")
def _(t: Tables):
    return C.delimiter_chunks(t.documents, "\n")


@query("c1_window_chunks")
def _(t: Tables):
    return C.window_chunks(t.documents)


@query("c7_semantic_chunks")
def _(t: Tables):
    return C.semantic_chunks(t.documents)


@query("c5_interval_overlap", """WITH o AS (SELECT lang AS source, doc_id AS old_id, (doc_id * 10) AS s, doc_id * 10 + n_chars % 40 AS e FROM documents), n AS (SELECT source, old_id + 1 AS new_id, s + 5 AS s, e + 9 AS e FROM o)
  SELECT source, new_id, old_id FROM o JOIN n USING (source) WHERE o.e > n.s AND o.s < n.e""")
def _(t: Tables):
    i = F.col("doc_id")
    o = t.documents.select(F.col("lang").alias("source"), i.alias("old_id"), (i * 10).alias("s"), (i * 10 + F.col("n_chars") % 40).alias("e"))
    n = o.select("source", (F.col("old_id") + 1).alias("new_id"), (F.col("s") + 5).alias("s"), (F.col("e") + 9).alias("e"))
    return C.interval_overlap(o, n)


@query("c9_conversations", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def _(t: Tables):
    return C.render_conversation(t.conversations)


@query("s6_sheet_chunks", """WITH l AS (SELECT (row_number() OVER (ORDER BY p_partkey) - 1) // 50 AS chunk_no, p_partkey, '| ' || p_brand || ' | ' || p_size || ' |' AS line FROM part)
  SELECT chunk_no, CASE WHEN chunk_no = 0 THEN 'Parts: brands' ELSE 'Parts (continued)' END || chr(10) || '| p_brand | p_size |' || chr(10) || '|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY p_partkey) AS text FROM l GROUP BY chunk_no""")
def _(t: Tables):
    return C.sheet_chunks(t.part, "p_partkey", ["p_brand", "p_size"], "Parts", "brands")


@query("s4_html_documents")
def _(t: Tables):
    return H.parse_pages(t.pages)


@query("f17_html_titles", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'), ' ') AS title FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", H.title(F.col("html")).alias("title"))


@query("f18_hrefs", """SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS n FROM pages""")
def _(t: Tables):
    return t.pages.select("page_id", F.size(H.hrefs(F.col("html"))).alias("n"))


@query("s1_file_routing", "SELECT url AS path, 'html' AS kind FROM (SELECT page_id, 'p' || page_id || '.html' AS url FROM pages WHERE page_id % 3 = 0)")
def _(t: Tables):
    ext = F.when(F.col("page_id") % 3 == 0, ".html").otherwise(".bin")
    return readers.route_files(t.pages.select(F.concat(F.lit("p"), "page_id", ext).alias("path")))


@query("s11_source_mapping", "SELECT source, list(doc_id ORDER BY doc_id) AS chunk_ids FROM documents GROUP BY source")
def _(t: Tables):
    return readers.source_mapping(t.documents.select(F.lit("f").alias("file"), F.col("doc_id").alias("line"), "source", F.col("doc_id").alias("chunk_id")))


@query("s10_unified_keys", "SELECT doc_id AS \"Id\", text AS chunk_id, lang FROM documents")
def _(t: Tables):
    return readers.unify_keys(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("ChunkId"), "lang"))


@query("s15_extraction_ready", "SELECT source AS source_chunk, text FROM documents WHERE source <> '' AND text <> ''")
def _(t: Tables):
    return t.documents.where("source <> '' AND text <> ''").select(F.col("source").alias("source_chunk"), "text")


@query("c2_page_texts", "SELECT source, 0 AS page, replace(text, chr(10), ',') AS text FROM documents")
def _(t: Tables):
    page = F.array(F.struct(F.lit("x").alias("type"), F.lit("skip").alias("text")), F.struct(F.lit("merge_text").alias("type"), F.col("text").alias("text")))
    return readers.page_texts(t.documents.select("source", F.create_map(F.lit("page_0"), page, F.lit("page_2"), page).alias("pages")))


@query("k2_chunk_rows", "SELECT doc_id::VARCHAR AS chunk_id, substr(text, 1, 65000) AS content_text, source AS source_id, lang AS source_chunk, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM documents")
def _(t: Tables):
    c = t.documents.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content_text"), F.col("source").alias("source_id"), F.col("lang").alias("source_chunk"))
    r = writers.chunk_rows(c)
    return r.select("chunk_id", "content_text", "source_id", "source_chunk", F.size("content_tokens").alias("n"))


@query("k4_insert_missing", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 23, r_name FROM region WHERE r_regionkey + 23 NOT IN (SELECT n_nationkey FROM nation)")
def _(t: Tables):
    new = t.region.select((F.col("r_regionkey") + 23).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return writers.insert_missing(t.nation.select("n_nationkey", "n_name"), new, ["n_nationkey"])


@query("k5_delete", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t: Tables):
    return writers.delete(t.documents.select("doc_id"), t.labels.where("toxic = 1"), ["doc_id"])


@query("k6_upsert", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(t: Tables):
    e = t.events.select("user_id", "event_type", "event_id")
    return writers.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query("k7_drop_dataset", "SELECT doc_id, lang AS dataset FROM documents WHERE lang <> 'fr'")
def _(t: Tables):
    return writers.drop_dataset(t.documents.select("doc_id", F.col("lang").alias("dataset")), "fr")


@query("k11_bridge_export", "SELECT substr(sha256(n_name), 1, 32) AS cluster_id, doc_id AS chunk_id, source AS url FROM documents JOIN nation ON n_nationkey = doc_id % 25 WHERE source IN ('src1', 'src2')")
def _(t: Tables):
    from lakeloom.plans.fixtures import bridge

    return writers.export_bridge(bridge(t), ["src1", "src2"])


@query("m9_vector_row", "SELECT doc_id, '{\"lang\":\"' || lang || '\"}' AS attr, lang || ',' || source AS chunk_ids FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", *writers.pack_attributes(F.struct("lang"), F.array("lang", "source")))


@query("k13_wiki_index", "SELECT lang AS category, '## ' || lang || chr(10) || string_agg('- [[' || source || ']] ' || title, chr(10) ORDER BY title) AS text FROM (SELECT lang, source, lpad(doc_id::VARCHAR, 6, '0') AS title FROM documents) GROUP BY lang")
def _(t: Tables):
    p = t.documents.select(F.col("lang").alias("category"), F.col("source").alias("stem"), F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("title"))
    return writers.index_text(p)


@query("k13_wiki_index_whole", "SELECT lang AS category, '## ' || lang || chr(10) || string_agg('- [[' || source || ']] ' || title, chr(10) ORDER BY title) AS text FROM (SELECT lang, source, lpad(doc_id::VARCHAR, 12, '0') AS title FROM documents) GROUP BY lang")
def _(t: Tables):
    p = t.documents.select(F.col("lang").alias("category"), F.col("source").alias("stem"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("title"))
    return writers.index_text(p)


@query("m1_embedding_text", "SELECT n_nationkey, trim(coalesce(nullif(CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END, ''), 'n' || '-' || n_regionkey), ' ') AS t FROM nation")
def _(t: Tables):
    desc = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("")
    return t.nation.select("n_nationkey", F.trim(F.coalesce(F.nullif(desc, F.lit("")), F.concat_ws("-", F.lit("n"), "n_regionkey"))).alias("t"))


@query("m13_triples_text", "SELECT r_name, string_agg(n_name || ' -- part of -- ' || r_name, chr(10) ORDER BY n_name) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(t: Tables):
    g = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("n"))
    return g.select("r_name", F.array_join(F.transform("n", lambda x: F.concat(x, F.lit(" -- part of -- "), F.col("r_name"))), "\n").alias("text"))


@query("p12_entity_records", """SELECT doc_id, lang AS name FROM documents WHERE n_chars % 3 <> 0 AND lang <> ''""")
def _(t: Tables):
    line = F.when(F.col("n_chars") % 3 == 0, F.lit("(\"relation\"<|>x)")).otherwise(F.concat(F.lit("(\"entity\"<|>"), "lang", F.lit("<|>type<|>about)")))
    parts = F.split(F.regexp_extract(line, r"\((.*)\)", 1), r"<\|>")
    d = t.documents.select("doc_id", parts.alias("p")).where("size(p) >= 4 AND p[0] = '\"entity\"' AND trim(p[1]) <> '' AND trim(p[2]) <> '' AND trim(p[3]) <> ''")
    return d.select("doc_id", F.trim(F.col("p")[1]).alias("name"))


@query("p13_relation_records", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1.0 ELSE n_chars::DOUBLE END AS weight FROM documents WHERE lang <> 'en'")
def _(t: Tables):
    last = F.when(F.col("doc_id") % 4 == 0, F.lit("high")).otherwise(F.col("n_chars").cast("string"))
    p = F.split(F.concat_ws("<|>", F.lit("relationship"), F.lit("en"), "lang", F.lit("speaks"), F.lit("kw"), last), r"<\|>")
    d = t.documents.select("doc_id", p.alias("p")).where("size(p) >= 5 AND p[0] = 'relationship' AND p[1] <> p[2]")
    weight = F.when(T.is_float(F.element_at("p", -1)), F.element_at("p", -1).try_cast("double")).otherwise(F.lit(1.0))
    return d.select("doc_id", weight.alias("weight"))
