"""Merkle manifest of a dataset: a tree of leaves for each source, and a tree of their roots above.

Leaves are numbered in their source and dealt into superblocks of FAN ** LEVELS. A first pass
reduces each superblock to one node, round after round until a tree is one node; the few nodes
above then pass the siblings on the way to the root back down. In the last step leaves are
cogrouped with these outer nodes of their superblock, and one function finishes the reduction
inside, joins both parts of the proof and folds it over the claimed leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.session import materialize

#: Children of a node.
FAN = 3
#: Levels that one pass reduces; a superblock has FAN ** LEVELS nodes.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """sha256 of fields one after another, each '-' if null, else its length in bytes, a colon and its text."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in text]), 256)


def reduce_levels(nodes: list[str], whole: bool, levels: int) -> list[list[str]]:
    """nodes and what they reduce to: to one node if they are a whole tree, else levels times."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= levels:
        below = out[-1]
        out.append([_hash("".join(below[k : k + FAN])) for k in range(0, len(below), FAN)])
    return out


def path(levels: list[list[str]], place: int) -> list[tuple[str, str]]:
    """What stands left and right of a node in its run, level by level, below the last one."""
    out = []
    for nodes in levels[:-1]:
        first = place - place % FAN
        out.append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + FAN])))
        place //= FAN
    return out


def pack(steps: Sequence[tuple[str, str]]) -> str:
    return ",".join(f"{a}:{b}" for a, b in steps)


def unpack(text: str) -> list[tuple[str, str]]:
    return [tuple(s.split(":")) for s in text.split(",")] if text else []  # type: ignore[misc]


def fold(node: str, steps: Sequence[tuple[str, str]]) -> str:
    """The root that a node and its siblings give."""
    for left, right in steps:
        node = _hash(left + node + right)
    return node


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows(tree, seq, ...) with idx, from 0 in each tree in that order (nulls first; then seq, unique), and n, the tree's size.

    Ranges of the sorted table are counted for each tree, and places inside a range follow from
    the counts before it; a tree of any size is spread over ranges. The order of ranges is fixed
    once they are written.
    """
    keys = ["tree", *order, "seq"]
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "merkle-ranges")
    counts = ranged.groupBy("tree", "part").count()
    upto = W.partitionBy("tree").orderBy("part")  # a row for each range
    counts = counts.select("tree", "part", (F.sum("count").over(upto) - F.col("count")).alias("before"), F.sum("count").over(W.partitionBy("tree")).alias("n"))
    inside = F.row_number().over(W.partitionBy("tree", "part").orderBy(*[F.col(c).asc_nulls_first() for c in keys[1:]]))
    return ranged.withColumn("inside", inside).join(counts, ["tree", "part"]).withColumn("idx", F.col("inside") - 1 + F.col("before")).drop("inside", "before", "part")


def _block(idx: str, levels: int) -> Column:
    return F.floor(F.col(idx) / (FAN**levels)).cast("long").alias("block")


def climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """nodes(tree, idx, n, node) and the tables that superblocks reduce to, up to one of one node a tree."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        n = int(pdf["n"].iloc[0])
        top = reduce_levels(pdf["node"].tolist(), n <= FAN**levels, levels)[-1]
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "n": [-(-n // FAN**levels)], "node": top})

    out = [nodes]
    while len(out) == 1 or out[-1].agg(F.max("n")).first()[0] > 1:
        up = out[-1].select("tree", "idx", "n", "node", _block("idx", levels)).groupBy("tree", "block").applyInPandas(run, "tree string, idx long, n long, node string")
        out.append(materialize(up, "merkle-nodes"))
    return out


def _exchange(nodes: DataFrame, outer: DataFrame, levels: int, emit: Callable[[pd.DataFrame, list, dict], pd.DataFrame], schema: str) -> DataFrame:
    """Each superblock's nodes cogrouped with its outer(tree, idx, steps, subroot, root); emit(nodes, their own steps, outer row)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, above = left.sort_values("idx"), right.iloc[0].to_dict()
        inner = reduce_levels(left["node"].tolist(), int(left["n"].iloc[0]) <= FAN**levels, levels)
        return emit(left, [path(inner, k) for k in range(len(left))], above)

    left = nodes.withColumn("block", _block("idx", levels)).groupBy("tree", "block")
    right = outer.withColumn("block", F.col("idx")).groupBy("tree", "block")
    return left.cogroup(right).applyInPandas(run, schema)


def descend(tables: list[DataFrame], outer: DataFrame, levels: int, last: int) -> DataFrame:
    """From outer nodes of the uppermost table to those of tables[last]."""

    def emit(left: pd.DataFrame, own: list, above: dict) -> pd.DataFrame:
        tail = above["steps"]
        steps = [",".join(filter(None, (pack(s), tail))) for s in own]
        return pd.DataFrame({"tree": left["tree"], "idx": left["idx"], "steps": steps, "subroot": above["subroot"], "root": above["root"]})

    for k in range(len(tables) - 2, last - 1, -1):
        outer = materialize(_exchange(tables[k], outer, levels, emit, "tree string, idx long, steps string, subroot string, root string"), "merkle-outer")
    return outer


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source", claimed: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """docs -> doc_id, source, position, leaf, subroot, root, proof, proof_sha256, folded_root, verified.

    claimed gives fields whose values someone claims in place of the table's; their leaf is folded
    with the true siblings, and verified tells whether that gives the root. Leaves of a source
    ascend by id, null first; rows of one id follow each other by leaf, and equal rows are
    interchangeable. A null source is a source of its own, the first. Null fields and empty texts
    are told apart by the leaf's format. Other columns are ignored, whatever their names; an
    empty table gives no rows.

    Texts are read once and leave the scan as two digests. All else moves rows of some hundred
    bytes; a superblock of FAN ** levels of them is the most that one group holds.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, source string, position long, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean"
    tree = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    true = [F.col(f"`{c}`") for c in fields]
    other = leaf(*[(claimed or {}).get(c, F.col(f"`{c}`")) for c in fields])
    leaves = docs.select(F.col(id_col).alias("id"), tree.alias("tree"), leaf(*true).alias("node"), other.alias("claim"), F.monotonically_increasing_id().alias("seq"))
    leaves = materialize(leaves, "merkle-leaves")
    if leaves.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    leaves = materialize(numbered(leaves, "id", "node").drop("seq"), "merkle-leaves")

    leaves = leaves.withColumn("id", F.col("id").cast("string"))  # pandas would make whole numbers beside a null inexact
    tables = climb(leaves, levels)
    roots = tables[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node", F.monotonically_increasing_id().alias("seq"))
    roots = materialize(numbered(roots, "name").drop("seq"), "merkle-sources")
    above = climb(roots, levels)
    top = above[-1].select("tree", "idx", F.lit("").alias("steps"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    top = descend(above, top, levels, 0).select("idx", "steps", "root").join(roots.select("idx", "name", F.col("node").alias("subroot")), "idx")
    top = top.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "steps", "subroot", "root")
    outer = descend(tables, top, levels, 1)

    def emit(left: pd.DataFrame, own: list, higher: dict) -> pd.DataFrame:
        tail = unpack(higher["steps"])
        rest = "".join(a + b for a, b in tail)
        proofs = ["".join(a + b for a, b in s) + rest for s in own]
        folded = [fold(c, [*s, *tail]) for c, s in zip(left["claim"], own, strict=True)]
        name = left["tree"].iloc[0]
        return pd.DataFrame({
            "doc_id": left["id"], "source": name[1:] if name else None, "position": left["idx"], "leaf": left["node"], "subroot": higher["subroot"], "root": higher["root"],
            "proof": proofs, "proof_sha256": [_hash(p) for p in proofs], "folded_root": folded, "verified": [f == higher["root"] for f in folded],
        })

    out = _exchange(leaves, outer, levels, emit, schema.replace(f"doc_id {kind}", "doc_id string"))
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def without_line_ends(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """Claimed texts for a test of the manifest: line ends are gone where the id's crc32 is even."""
    even = F.crc32(F.col(id_col).cast("string")) % 2 == 0
    return {text_col: F.when(even, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))}


def manifest_sql() -> str:
    """The same for DuckDB, by recursion over levels."""
    step = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda a, k: {step})"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {byte}), 4294967295)"
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(field(c) for c in FIELDS[:-1])
    tampered = f"CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    grow = "SELECT tree, l + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM {0} WHERE n > 1 GROUP BY tree, l, idx // 3, n"
    return f"""WITH RECURSIVE t AS (SELECT *, {tampered} AS claim FROM documents),
  d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, sha256({head} || {field("text")}) AS leaf, sha256({head} || {field("claim")}) AS claim FROM t),
  p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d),
  low(tree, l, idx, n, h) AS (SELECT tree, 0, idx, n, leaf FROM p UNION ALL {grow.format("low")}),
  roots AS (SELECT tree AS name, l AS height, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
  high(tree, l, idx, n, h) AS (SELECT '', 0, idx, n, subroot FROM roots UNION ALL {grow.format("high")}),
  top AS (SELECT h AS root, l AS height FROM high WHERE n = 1),
  leaves AS (SELECT p.*, r.height, r.subroot, r.idx AS ridx, top.root, top.height AS above FROM p JOIN roots r ON r.name = p.tree, top),
  ways AS (SELECT doc_id, tree, l, 0 AS upper, idx // (3 ** l)::BIGINT AS at FROM (SELECT *, unnest(range(height)) AS l FROM leaves)
    UNION ALL SELECT doc_id, '', height + l, 1, ridx // (3 ** l)::BIGINT FROM (SELECT *, unnest(range(above)) AS l FROM leaves)),
  nodes AS (SELECT 0 AS upper, tree, l, idx, h FROM low UNION ALL SELECT 1, '', l, idx, h FROM high),
  sib AS (SELECT w.doc_id, w.l, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (WHERE s.idx < w.at), '') AS a, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (WHERE s.idx > w.at), '') AS b
    FROM ways w JOIN leaves v USING (doc_id) JOIN nodes s ON s.upper = w.upper AND s.tree = w.tree AND s.l = w.l - w.upper * v.height AND s.idx // 3 = w.at // 3 GROUP BY w.doc_id, w.l),
  folds(doc_id, l, h) AS (SELECT doc_id, 0::BIGINT, claim FROM p UNION ALL SELECT f.doc_id, f.l + 1, sha256(a || f.h || b) FROM folds f JOIN sib s ON s.doc_id = f.doc_id AND s.l = f.l),
  proofs AS (SELECT doc_id, string_agg(a || b, '' ORDER BY l) AS proof FROM sib GROUP BY doc_id)
SELECT v.doc_id, v.leaf, v.subroot, v.root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = v.root AS verified
FROM leaves v JOIN folds f ON f.doc_id = v.doc_id AND f.l = v.height + v.above LEFT JOIN proofs q ON q.doc_id = v.doc_id"""
