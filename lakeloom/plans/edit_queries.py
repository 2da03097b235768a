"""Queries of graphs that users edit, of their exports and of stored relation rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.text import sha32
from lakeloom.operators.graph_edits import EDIT, GraphEditor
from lakeloom.plans import fixtures as X
from lakeloom.plans.registry import Tables, query
from lakeloom.plans.store_queries import fresh
from lakeloom.sources import writers


def graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Customers, suppliers, nations and regions as entities; the edges of the example graph as relations."""
    kinds = [("customer", t.customer, "c_name", "c_custkey"), ("supplier", t.supplier, "s_name", "s_suppkey"), ("nation", t.nation, "n_name", "n_nationkey"), ("region", t.region, "r_name", "r_regionkey")]
    rows = [df.select(F.col(n).alias("name"), F.lit(k).alias("type"), F.concat(F.lit(f"{k} "), k_ := F.col(key).cast("string")).alias("description"), F.concat(F.lit(k[0]), k_).alias("source_id")) for k, df, n, key in kinds]
    r = X.edges(t).select(F.col("node1").alias("a"), F.col("node2").alias("b"), "keywords", "weight", F.concat_ws(" ", F.lit("from"), "source_id").alias("description"), "source_id")
    return reduce(DataFrame.unionByName, rows), r


def edits(t: Tables) -> DataFrame:
    """Rules of the keys: every kind of edit, some that are refused. Ids follow the rule, then the key."""
    n = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), "n_name")
    before = t.customer.select((F.col("c_custkey") + 1).alias("k"), F.col("c_name").alias("before"))
    columns = {c.split()[0]: c.split()[1] for c in EDIT.split(", ")}

    def rule(number: int, df: DataFrame, op: str, key: str, **values) -> DataFrame:
        v = {"edit_id": F.lit(number * 10_000_000_000) + F.col(key), "op": F.lit(op)} | values
        return df.select(*[v.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])

    name, nation = F.col("name"), F.col("n_name")
    rules = [
        rule(0, n.where("k % 50 = 0"), "create_entity", "k", name=F.concat(F.lit("new "), "k"), description=F.lit("added")),
        rule(1, t.nation, "create_entity", "n_nationkey", name=nation),
        rule(2, n.where("k % 6 = 0"), "edit_entity", "k", name=name, type=F.lit("vip")),
        rule(3, n.where("k % 10 = 5"), "create_relation", "k", name=name, other=F.lit("ASIA"), keywords=F.lit("visits")),
        rule(4, n.where("k % 10 = 5"), "create_relation", "k", name=name, other=F.lit("ATLANTIS")),
        rule(5, n.where("k % 4 = 0"), "edit_relation", "k", name=nation, other=name, weight=F.lit(9.0), keywords=F.lit("vip")),
        rule(6, n.where("k % 10 = 8"), "delete_relation", "k", name=name, other=nation),
        rule(7, t.supplier.where("s_suppkey % 7 = 0"), "delete_entity", "s_suppkey", name=F.col("s_name")),
        rule(8, n.where("k % 10 = 3").join(before, "k"), "merge_entity", "k", name=name, other=F.col("before")),
        rule(9, t.nation.where("n_nationkey % 5 = 0"), "rename_entity", "n_nationkey", name=nation, other=F.concat(F.lit("land of "), "n_name")),
        rule(10, t.nation.where("n_nationkey % 5 = 1"), "rename_entity", "n_nationkey", name=nation, other=F.lit("EUROPE")),
    ]
    return reduce(DataFrame.unionByName, rules)


_NATION = "CASE WHEN n_nationkey % 5 = 0 THEN 'land of ' || n_name ELSE n_name END"
_SQL = f"""WITH c AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, n_name, {_NATION} AS land, CASE WHEN c_custkey % 6 = 0 THEN 'vip' ELSE 'customer' END AS type FROM customer JOIN nation ON c_nationkey = n_nationkey),
  p AS (SELECT c.*, b.name AS target FROM c LEFT JOIN c b ON b.k = c.k - 1 AND c.k % 10 = 3),
  ent AS (SELECT name, type, 'customer ' || k AS description, 'c' || k AS source_id, k FROM p WHERE target IS NULL AND k % 10 <> 2
    UNION ALL SELECT b.name, coalesce(m.type, b.type), coalesce('customer ' || m.k || chr(10) || chr(10), '') || 'customer ' || b.k, array_to_string(list_sort(list_filter(['c' || m.k, 'c' || b.k], lambda x: x IS NOT NULL)), '<SEP>'), b.k FROM c b LEFT JOIN p m ON m.target = b.name WHERE b.k % 10 = 2
    UNION ALL SELECT s_name, 'supplier', 'supplier ' || s_suppkey, 's' || s_suppkey, 0 FROM supplier WHERE s_suppkey % 7 <> 0
    UNION ALL SELECT {_NATION}, 'nation', 'nation ' || n_nationkey, 'n' || n_nationkey, 0 FROM nation UNION ALL SELECT r_name, 'region', 'region ' || r_regionkey, 'r' || r_regionkey, 0 FROM region
    UNION ALL SELECT 'new ' || k, 'UNKNOWN', 'added', 'manual', 0 FROM c WHERE k % 50 = 0),
  r AS (SELECT coalesce(target, name) AS x, land AS y, name AS x0, n_name AS y0, CASE WHEN k % 4 = 0 THEN 'vip' ELSE seg END AS keywords, CASE WHEN k % 4 = 0 THEN 9.0 ELSE 1.0 END::DOUBLE AS weight, 'from customer' AS description, 'customer' AS source_id FROM p WHERE k % 10 <> 8
    UNION ALL SELECT name, 'ASIA', name, 'ASIA', 'visits', 1.0, '', 'manual' FROM c WHERE k % 10 = 5
    UNION ALL SELECT s_name, {_NATION}, s_name, n_name, 'supplies', 2.0, 'from supplier', 'supplier' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 0
    UNION ALL SELECT {_NATION}, r_name, n_name, r_name, 'part of', 1.0, 'from nation', 'nation' FROM nation JOIN region ON n_regionkey = r_regionkey),
  rel AS (SELECT least(x, y) AS a, greatest(x, y) AS b, CASE WHEN count(*) = 1 THEN any_value(keywords) ELSE array_to_string(list_sort(list_distinct(list(keywords))), ',') END AS keywords, max(weight) AS weight,
    string_agg(description, chr(10) || chr(10)) AS description, array_to_string(list_sort(list_distinct(list(source_id))), '<SEP>') AS source_id FROM r GROUP BY ALL),
  o AS (SELECT 'create_entity done' AS name, count(*) AS n FROM c WHERE k % 50 = 0 UNION ALL SELECT 'create_entity exists', count(*) FROM nation UNION ALL SELECT 'edit_entity done', count(*) FROM c WHERE k % 6 = 0
    UNION ALL SELECT 'create_relation done', count(*) FROM c WHERE k % 10 = 5 UNION ALL SELECT 'create_relation missing', count(*) FROM c WHERE k % 10 = 5 UNION ALL SELECT 'edit_relation done', count(*) FROM c WHERE k % 4 = 0
    UNION ALL SELECT 'delete_relation done', count(*) FROM c WHERE k % 10 = 8 UNION ALL SELECT 'delete_entity done', count(*) FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT 'merge_entity done', count(*) FROM p WHERE target IS NOT NULL
    UNION ALL SELECT 'rename_entity done', count(*) FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'rename_entity exists', count(*) FROM nation WHERE n_nationkey % 5 = 1),
  v AS (SELECT 'ent-' || md5(name) AS vid, name || chr(10) || description AS content FROM ent UNION ALL SELECT 'rel-' || md5(a || b), a || chr(9) || b || chr(10) || keywords || chr(10) || description FROM rel)
  SELECT 'entity' AS part, name, NULL AS other, type AS label, description, source_id, NULL::DOUBLE AS weight FROM ent UNION ALL SELECT 'relation', a, b, keywords, description, source_id, weight FROM rel
  UNION ALL SELECT 'outcome', name, NULL, NULL, NULL, NULL, n FROM o WHERE n > 0 UNION ALL SELECT 'vector', vid, NULL, NULL, sha256(content), NULL, NULL FROM v"""


def edited(t: Tables) -> tuple[GraphEditor, DataFrame]:
    editor = GraphEditor(t.spark, fresh(t, "edited"), 16)
    editor.load(*graph(t))
    return editor, editor.apply("edits", edits(t))


@query("g5_graph_edits", _SQL)
def _(t: Tables):
    """Entities, relations, vectors and outcomes after one batch of edits of all kinds."""
    editor, outcomes = edited(t)
    none = lambda kind="string": F.lit(None).cast(kind)
    e = editor.entities.read().select(F.lit("entity").alias("part"), "name", none().alias("other"), F.col("type").alias("label"), "description", "source_id", none("double").alias("weight"))
    r = editor.relations().select(F.lit("relation"), "a", "b", "keywords", "description", "source_id", "weight")
    o = outcomes.groupBy(F.concat_ws(" ", "op", "outcome").alias("name")).agg(F.count("*").cast("double").alias("n")).select(F.lit("outcome"), "name", none(), none(), none(), none(), "n")
    v = editor.vectors.read().select(F.lit("vector"), "vid", none(), none(), F.sha2("content", 256), none(), none("double"))
    return e.union(r).union(o).union(v)


@query("m34_graph_info", """WITH d AS (SELECT n_name, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation) JOIN nation ON n_nationkey = k GROUP BY n_name)
  SELECT n_name AS name, n_name IS NOT NULL AS stored, 'nation ' || n_nationkey AS description, n AS degree, n_name || chr(10) || 'nation ' || n_nationkey AS content, true AS has_vector FROM nation JOIN d USING (n_name)
  UNION ALL SELECT 'no ' || n_name, false, NULL, 0, NULL, false FROM nation
  UNION ALL SELECT s_name || '|' || n_name, true, 'from supplier', NULL, least(s_name, n_name) || chr(9) || greatest(s_name, n_name) || chr(10) || 'supplies' || chr(10) || 'from supplier', true FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(t: Tables):
    """Entities and relations looked up by name, with their vectors; some names aren't there."""
    editor = GraphEditor(t.spark, fresh(t, "edited"), 16)
    editor.load(*graph(t))
    names = t.nation.select(F.explode(F.array("n_name", F.concat(F.lit("no "), "n_name"))).alias("name"))
    has = F.coalesce(F.size("v") == 16, F.lit(False)).alias("has_vector")
    e = editor.entity_info(names, vectors=True).select("name", F.col("type").isNotNull().alias("stored"), "description", F.col("degree").cast("long").alias("degree"), "content", has)
    pairs = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("a"), F.col("n_name").alias("b"))
    r = editor.relation_info(pairs, vectors=True)
    supplier = F.when(F.col("a").startswith("Supplier"), F.concat_ws("|", "a", "b")).otherwise(F.concat_ws("|", "b", "a"))
    return e.unionByName(r.select(supplier.alias("name"), F.col("weight").isNotNull().alias("stored"), "description", F.lit(None).cast("long").alias("degree"), "content", has))


@query("k3_relation_rows", f"WITH {X.EDGES} SELECT substr(sha256(node1 || node2), 1, 32) AS relation_id, substr(sha256(node1), 1, 32) AS node1, substr(sha256(node2), 1, 32) AS node2, 'triple' AS type, keywords AS relation, 'from ' || source_id AS description FROM edges")
def _(t: Tables):
    r = graph(t)[1].select(sha32(F.concat("a", "b")).alias("relation_id"), sha32(F.col("a")).alias("node1"), sha32(F.col("b")).alias("node2"), F.col("keywords").alias("relation"), "description")
    return writers.relation_rows(r)


_EXPORT = f"""WITH {X.EDGES}, ent AS (SELECT c_name AS name, 'customer' AS type, 'customer ' || c_custkey AS description, 'c' || c_custkey AS source_id FROM customer UNION ALL SELECT s_name, 'supplier', 'supplier ' || s_suppkey, 's' || s_suppkey FROM supplier
    UNION ALL SELECT n_name, 'nation', 'nation ' || n_nationkey, 'n' || n_nationkey FROM nation UNION ALL SELECT r_name, 'region', 'region ' || r_regionkey, 'r' || r_regionkey FROM region),
  rel AS (SELECT node1 AS a, node2 AS b, keywords, weight::VARCHAR AS weight, 'from ' || source_id AS description, source_id FROM edges)"""
_TABLE = {"entities": ("ent", ["name", "type", "description", "source_id"]), "relations": ("rel", ["a", "b", "keywords", "weight", "description", "source_id"])}


def _lines(kind: str, section: str) -> str:
    table, names = _TABLE[section]
    if kind == "md":
        row = "'| ' || " + " || ' | ' || ".join(names) + " || ' |'"
        head = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    elif kind == "csv":
        row, head = " || ',' || ".join(names), [",".join(names)]
    else:
        row, head = " || chr(10) || ".join(f"'{n}: ' || {n}" for n in names) + " || chr(10)", []
    heads = " ".join(f"UNION ALL SELECT '{kind}', '{section}', '{h}'" for h in head)
    if kind == "txt":
        return f"SELECT '{kind}' AS kind, '{section}' AS section, unnest(string_split({row}, chr(10))) AS line FROM {table}"
    return f"SELECT '{kind}' AS kind, '{section}' AS section, {row} AS line FROM {table} {heads}"


@query("k9_graph_files", f"{_EXPORT} SELECT kind, section, line, count(*) AS n FROM (" + " UNION ALL ".join(_lines(k, s) for k in ("csv", "md", "txt") for s in _TABLE) + ") GROUP BY ALL")
def _(t: Tables):
    """The graph in files of three formats, read back as lines; a header comes once for each table, in its first file."""
    entities, relations = graph(t)
    parts = []
    for kind in ("csv", "md", "txt"):
        folder = fresh(t, f"export-{kind}")
        writers.export_graph(entities, relations, folder, kind)
        for section in ("entities", "relations"):
            lines = t.spark.read.text(f"{folder}/{section}").select(F.lit(kind).alias("kind"), F.lit(section).alias("section"), F.col("value").alias("line"))
            parts.append(lines.groupBy("kind", "section", "line").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)
