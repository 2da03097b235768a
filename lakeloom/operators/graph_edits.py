"""Edits that users make to a stored graph: entities and relations created, changed, renamed, merged and deleted by batches.

A batch is a table of edits. All are judged and made by joins with what the names in them hold;
only the buckets of names, relations and vectors that change are written anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.records import hashed_vector
from lakeloom.functions.text import terms
from lakeloom.session import materialize
from lakeloom.sources.keyed import KeyedTable, logged

ENTITY = ["name", "type", "description", "source_id"]
RELATION = ["a", "b", "keywords", "weight", "description", "source_id"]
EDIT = "edit_id long, op string, name string, other string, type string, description string, keywords string, weight double, source_id string"
OPS = ["create_entity", "edit_entity", "create_relation", "edit_relation", "delete_relation", "delete_entity", "rename_entity", "merge_entity"]
SEP = "<SEP>"


def entity_id(name: Column) -> Column:
    return F.concat(F.lit("ent-"), F.md5(name))


def relation_id(a: Column, b: Column) -> Column:
    return F.concat(F.lit("rel-"), F.md5(F.concat(a, b)))


def _flag(df: DataFrame, there: DataFrame, keys: dict[str, str], flag: str) -> DataFrame:
    """df with a boolean: whether its columns keys.values() are among the distinct rows of there's columns keys.keys()."""
    k = there.select(*[F.col(a).alias(f"_{b}") for a, b in keys.items()]).distinct().withColumn(flag, F.lit(True))
    on = [df[b] == k[f"_{b}"] for b in keys.values()]
    return df.join(k, on, "left").drop(*[f"_{b}" for b in keys.values()]).withColumn(flag, F.coalesce(flag, F.lit(False)))


def _override(rows: DataFrame, edits: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """rows with those fields of edits that aren't null in place of their own."""
    new = edits.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    return rows.join(new, keys, "left").select(*keys, *[F.coalesce(f"_{f}", f).alias(f) for f in fields])


def _united(values: Column, sep: str) -> Column:
    """Distinct sorted parts of an array of joined strings, joined again."""
    parts = F.flatten(F.transform(values, lambda x: F.split(F.coalesce(x, F.lit("")), sep, -1)))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))), sep)


def _filled(values: Column) -> Column:
    return F.filter(values, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")


def merged_entities(entities: DataFrame, moves: DataFrame) -> DataFrame:
    """entities after moves(name, other, edit_id): those that move are merged into the entity other, there already or new.

    Descriptions that aren't blank follow one another in the moves' order, the target's own comes
    last; the first type that isn't blank stays; sources are united. Others keep what they have.
    """
    m = entities.join(moves.select("name", "other", "edit_id"), "name", "left")
    touched = moves.select(F.col("other").alias("name")).distinct()
    still = m.where("other IS NULL").join(touched, "name", "left_anti").select(*ENTITY)
    joint = m.where("other IS NOT NULL").unionByName(m.where("other IS NULL").join(touched, "name", "left_semi"))
    order = F.struct(F.coalesce("edit_id", F.lit(2**63 - 1)).alias("at"), "type", "description", "source_id")
    g = joint.groupBy(F.coalesce("other", "name").alias("name")).agg(F.array_sort(F.collect_list(order)).alias("m"))
    field = lambda f: F.transform("m", lambda x: x[f])
    new = g.select("name", F.get(_filled(field("type")), F.lit(0)).alias("type"), F.array_join(_filled(field("description")), "\n\n").alias("description"), _united(field("source_id"), SEP).alias("source_id"))
    return still.unionByName(new)


def moved_relations(relations: DataFrame, moves: DataFrame) -> DataFrame:
    """relations with the ends that moves(name, other) give; self-loops go.

    Relations that come to have the same two ends are one: descriptions in the order of their old
    ends, united keywords and sources, the greatest weight. Others keep what they have.
    """
    r = relations.select(F.col("a").alias("a0"), F.col("b").alias("b0"), *RELATION)
    for end in ("a", "b"):
        to = moves.select(F.col("name").alias(end), F.col("other").alias(f"to_{end}"))
        r = r.join(to, end, "left").withColumn(end, F.coalesce(f"to_{end}", end))
    r = r.where("a <> b").withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    rest = F.struct("a0", "b0", "keywords", "weight", "description", "source_id")
    g = r.groupBy(F.col("lo").alias("a"), F.col("hi").alias("b")).agg(F.array_sort(F.collect_list(rest)).alias("m"))
    field = lambda f: F.transform("m", lambda x: x[f])
    one = F.size("m") == 1
    first = lambda f: F.col("m")[0][f]
    return g.select(
        "a", "b", F.when(one, first("keywords")).otherwise(_united(field("keywords"), ",")).alias("keywords"), F.array_max(field("weight")).alias("weight"),
        F.when(one, first("description")).otherwise(F.array_join(_filled(field("description")), "\n\n")).alias("description"),
        F.when(one, first("source_id")).otherwise(_united(field("source_id"), SEP)).alias("source_id"),
    )


def judge(edits: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, entities, relations): edits made to the entities and relations that their names hold.

    edits have the columns of EDIT; for relations and moves ``other`` is the second end or the
    target. Edits are made by kind in the order of OPS, each judged by what the kinds before left.
    An outcome is 'done' or why an edit was refused: 'no name' (blank), 'no such edit', 'repeated'
    (an edit of lower edit_id does the same to the same name or pair), 'missing' (the entity, the
    relation or an end), 'exists', 'same name' (equal ends, or a move onto itself), 'target moves'
    (a move onto a name that the batch moves). Of several moves onto one name only the first may be
    a rename. Fields that are null in an edit stay; a created one has defaults.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    two = F.col("op").isin("create_relation", "edit_relation", "delete_relation", "rename_entity", "merge_entity")
    pair = F.col("op").endswith("_relation")
    # a rename and a merge of one name are the same kind of edit
    kind = F.when(F.col("op").isin("rename_entity", "merge_entity"), "move").otherwise(F.col("op"))
    key = F.when(pair, F.struct(F.least("name", "other").alias("x"), F.greatest("name", "other").alias("y"))).otherwise(F.struct(F.col("name").alias("x"), F.lit(None).cast("string").alias("y")))
    refused = F.when(~F.col("op").isin(*OPS) | F.col("op").isNull(), "no such edit").when(blank(F.col("name")) | (two & blank(F.col("other"))), "no name").when(two & (F.col("name") == F.col("other")), "same name")
    e = edits.select(*edits.sparkSession.createDataFrame([], EDIT).columns).withColumn("refused", refused).withColumn("a", F.least("name", "other")).withColumn("b", F.greatest("name", "other"))
    again = F.row_number().over(W.partitionBy(F.col("refused").isNull(), kind, key).orderBy("edit_id")) > 1
    e = materialize(e.withColumn("again", again).withColumn("refused", F.when(F.col("refused").isNull() & F.col("again"), "repeated").otherwise(F.col("refused"))).drop("again"), "graph-edits")
    outcomes = [e.where("refused IS NOT NULL").select("edit_id", "op", F.col("refused").alias("outcome"))]

    def some(*ops: str) -> DataFrame:
        return e.where(F.col("refused").isNull() & F.col("op").isin(*ops)).drop("refused")

    def settle(judged: DataFrame, outcome: Column) -> DataFrame:
        j = materialize(judged.withColumn("outcome", outcome), "graph-judged")
        outcomes.append(j.select("edit_id", "op", "outcome"))
        return j.where("outcome = 'done'")

    there = lambda flag, word: F.when(F.col(flag), word)
    new = settle(_flag(some("create_entity"), entities, {"name": "name"}, "here"), there("here", "exists").otherwise("done"))
    defaults = [F.coalesce("type", F.lit("UNKNOWN")).alias("type"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("source_id", F.lit("manual")).alias("source_id")]
    entities = entities.select(*ENTITY).unionByName(new.select("name", *defaults))
    changed = settle(_flag(some("edit_entity"), entities, {"name": "name"}, "here"), there("here", "done").otherwise("missing"))
    entities = materialize(_override(entities, changed, ["name"], ENTITY[1:]), "graph-entities")

    new = some("create_relation")
    for end in ("a", "b"):
        new = _flag(new, entities, {"name": end}, f"has_{end}")
    new = settle(_flag(new, relations, {"a": "a", "b": "b"}, "here"), F.when(~F.col("has_a") | ~F.col("has_b"), "missing").when(F.col("here"), "exists").otherwise("done"))
    relations = relations.select(*RELATION).unionByName(new.select("a", "b", F.coalesce("keywords", F.lit("")).alias("keywords"), F.coalesce("weight", F.lit(1.0)).alias("weight"), *defaults[1:]))
    changed = settle(_flag(some("edit_relation"), relations, {"a": "a", "b": "b"}, "here"), there("here", "done").otherwise("missing"))
    relations = _override(relations, changed, ["a", "b"], RELATION[2:])
    gone = settle(_flag(some("delete_relation"), relations, {"a": "a", "b": "b"}, "here"), there("here", "done").otherwise("missing"))
    relations = relations.join(gone.select("a", "b"), ["a", "b"], "left_anti")

    dead = settle(_flag(some("delete_entity"), entities, {"name": "name"}, "here"), there("here", "done").otherwise("missing")).select("name")
    entities = materialize(entities.join(dead, "name", "left_anti"), "graph-entities")
    for end in ("a", "b"):
        relations = relations.join(dead.withColumnRenamed("name", end), end, "left_anti")

    moves = some("rename_entity", "merge_entity")
    moves = _flag(_flag(_flag(moves, entities, {"name": "name"}, "here"), entities, {"name": "other"}, "taken"), moves, {"name": "other"}, "leaves")
    moves = moves.withColumn("why", F.when(~F.col("here"), "missing").when(F.col("leaves"), "target moves").when((F.col("op") == "rename_entity") & F.col("taken"), "exists"))
    turn = F.row_number().over(W.partitionBy(F.col("why").isNull(), "other").orderBy("edit_id"))
    moves = settle(moves.withColumn("turn", turn), F.coalesce("why", F.when((F.col("op") == "rename_entity") & (F.col("turn") > 1), "exists"), F.lit("done")))
    every = outcomes[0]
    for o in outcomes[1:]:
        every = every.unionByName(o)
    return every, merged_entities(entities, moves), moved_relations(relations.select(*RELATION), moves)


class GraphEditor:
    """A graph below one folder that users edit: entities by name, relations under either end, and the vectors of both by id.

    embed gives the vector of a text; the default counts hashed words.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, embed: Callable[[Column], Column] | None = None) -> None:
        table = lambda name, schema, *keys: KeyedTable(spark, f"{path}/{name}", schema, list(keys), buckets)
        self.spark, self.path = spark, path
        self.embed = embed or (lambda text: hashed_vector(terms(text), 16))
        self.entities = table("entities", "name string, type string, description string, source_id string", "name")
        self.ends = table("ends", "node string, a string, b string, keywords string, weight double, description string, source_id string", "node")
        self.vectors = table("vectors", "vid string, content string, v array<double>", "vid")

    def relations(self) -> DataFrame:
        return self.ends.read().where("node = a").select(*RELATION)

    def _contents(self, entities: DataFrame, relations: DataFrame) -> DataFrame:
        text = lambda *c: F.concat(*[F.coalesce(x, F.lit("")) for x in c])
        e = entities.select(entity_id(F.col("name")).alias("vid"), text(F.col("name"), F.lit("\n"), F.col("description")).alias("content"))
        r = relations.select(relation_id(F.col("a"), F.col("b")).alias("vid"), text(F.col("a"), F.lit("\t"), F.col("b"), F.lit("\n"), F.col("keywords"), F.lit("\n"), F.col("description")).alias("content"))
        every = e.unionByName(r)
        return every.select("vid", "content", self.embed(F.col("content")).alias("v"))

    def _difference(self, old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> dict[str, DataFrame]:
        """What the tables change by when entities and relations go from old to new."""
        (e0, r0), (e1, r1) = old, new
        lost_e, came_e = materialize(e0.subtract(e1), "graph-lost"), materialize(e1.subtract(e0), "graph-came")
        lost_r, came_r = materialize(r0.subtract(r1), "graph-lost"), materialize(r1.subtract(r0), "graph-came")
        ends = lambda df: df.select(F.explode(F.array("a", "b")).alias("node"), *RELATION)
        nodes = materialize(ends(lost_r).unionByName(ends(came_r)).select("node").distinct(), "graph-ends")
        stay = self.ends.lookup(nodes).join(lost_r.select("a", "b"), ["a", "b"], "left_anti").select(*self.ends.columns)
        ids = lost_r.select(F.explode(F.array(relation_id(F.col("a"), F.col("b")), relation_id(F.col("b"), F.col("a")))).alias("vid"))
        return {
            "entities": self._with_gone(self.entities, lost_e.select("name"), came_e), "ends": self._with_gone(self.ends, nodes, stay.unionByName(ends(came_r))),
            "vectors": self._with_gone(self.vectors, lost_e.select(entity_id(F.col("name")).alias("vid")).unionByName(ids), self._contents(came_e, came_r)),
        }

    def _with_gone(self, table: KeyedTable, keys: DataFrame, rows: DataFrame) -> DataFrame:
        fields = self.spark.createDataFrame([], table.schema).schema
        marks = [F.col(f.name) if f.name in table.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        return keys.select(*marks, F.lit(True).alias("gone")).unionByName(rows.select(*table.columns, F.lit(False).alias("gone")))

    def load(self, entities: DataFrame, relations: DataFrame, tag: str = "load") -> None:
        """The first graph: entities(name, ...), one row a name, relations(a, b, ...), one row a pair whatever its order; blank and equal ends go."""
        e = entities.where("coalesce(trim(name), '') <> ''").select(*ENTITY)
        r = relations.where("coalesce(trim(a), '') <> '' AND coalesce(trim(b), '') <> '' AND a <> b")
        r = r.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *RELATION[2:])
        changes = logged(self.spark, f"{self.path}/log", tag, lambda: self._difference((e.limit(0), r.limit(0)), (e, r)))
        for name, df in changes.items():
            getattr(self, name).replace(df, tag)

    def apply(self, tag: str, edits: DataFrame) -> DataFrame:
        """(edit_id, op, outcome) of a batch of edits (see judge). The same tag again changes nothing; a batch that died goes on."""

        def compute() -> dict[str, DataFrame]:
            names = materialize(edits.select(F.explode(F.array("name", "other")).alias("name")).where("coalesce(trim(name), '') <> ''").distinct(), "graph-names")
            e = materialize(self.entities.lookup(names), "graph-old")
            r = materialize(self.ends.lookup(names.select(F.col("name").alias("node"))).select(*RELATION).distinct(), "graph-old")
            outcomes, e1, r1 = judge(edits, e, r)
            return {"outcomes": outcomes} | self._difference((e, r), (materialize(e1, "graph-new"), materialize(r1, "graph-new")))

        changes = logged(self.spark, f"{self.path}/log", tag, compute)
        for name in ("entities", "ends", "vectors"):
            getattr(self, name).replace(changes[name], tag)
        return changes["outcomes"]

    def entity_info(self, names: DataFrame, vectors: bool = False) -> DataFrame:
        """names(name) with what is stored: type, description, source_id, degree, and the vector row if asked; null where there is none."""
        n = names.where("name IS NOT NULL").select("name").distinct()
        found = n.join(self.entities.lookup(n), "name", "left")
        degree = self.ends.lookup(n.select(F.col("name").alias("node"))).groupBy(F.col("node").alias("name")).agg(F.count("*").alias("degree"))
        return self._vector(found.join(degree, "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("vid", entity_id(F.col("name"))), vectors)

    def relation_info(self, pairs: DataFrame, vectors: bool = False) -> DataFrame:
        """pairs(a, b), in either order, with what is stored of their relation."""
        p = pairs.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        stored = self.ends.lookup(p.select(F.col("a").alias("node"))).where("node = a").select(*RELATION)
        return self._vector(p.join(stored, ["a", "b"], "left").withColumn("vid", relation_id(F.col("a"), F.col("b"))), vectors)

    def _vector(self, rows: DataFrame, wanted: bool) -> DataFrame:
        if not wanted:
            return rows
        rows = materialize(rows, "graph-info")
        return rows.join(self.vectors.lookup(rows.select("vid")), "vid", "left")
