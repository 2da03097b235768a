"""Edits of a stored graph against the same edits made one by one over dictionaries."""

import random
import uuid

from lakeloom.operators.graph_edits import EDIT, OPS, GraphEditor
from lakeloom.session import shared_dir

COLS = [c.split()[0] for c in EDIT.split(", ")]


def united(values, sep):
    return sep.join(sorted({p.strip() for v in values for p in (v or "").split(sep) if p.strip()}))


def filled(values):
    return [v for v in values if v is not None and v.strip(" ")]


def by_hand(entities, relations, edits):
    """entities {name: (type, description, source)}, relations {(a, b): (keywords, weight, description, source)}; gives outcomes."""
    out, seen, ready = {}, set(), []
    for e in sorted(edits, key=lambda e: e[0]):
        i, op, n, o = e[:4]
        two = op in OPS[2:5] + OPS[6:]
        if op not in OPS:
            out[i] = "no such edit"
        elif not (n or "").strip(" ") or two and not (o or "").strip(" "):
            out[i] = "no name"
        elif two and n == o:
            out[i] = "same name"
        else:
            k = ("move" if op in OPS[6:] else op, tuple(sorted((n, o))) if op.endswith("relation") else n)
            if k in seen:
                out[i] = "repeated"
            else:
                ready.append(e)
            seen.add(k)
    pick = lambda *ops: [e for e in ready if e[1] in ops]
    over = lambda new, old: tuple(o if n is None else n for n, o in zip(new, old))
    for i, _, n, _, t, d, k, w, s in pick("create_entity"):
        out[i] = "exists" if n in entities else "done"
        entities.setdefault(n, over((t, d, s), ("UNKNOWN", "", "manual")))
    for i, _, n, _, t, d, k, w, s in pick("edit_entity"):
        out[i] = "done" if n in entities else "missing"
        if n in entities:
            entities[n] = over((t, d, s), entities[n])
    for i, _, n, o, t, d, k, w, s in pick("create_relation"):
        p = tuple(sorted((n, o)))
        out[i] = "missing" if n not in entities or o not in entities else "exists" if p in relations else "done"
        if out[i] == "done":
            relations[p] = over((k, w, d, s), ("", 1.0, "", "manual"))
    for i, op, n, o, t, d, k, w, s in pick("edit_relation") + pick("delete_relation"):
        p = tuple(sorted((n, o)))
        out[i] = "done" if p in relations else "missing"
        if p in relations and op == "edit_relation":
            relations[p] = over((k, w, d, s), relations[p])
        elif p in relations:
            del relations[p]
    for i, _, n, *_ in pick("delete_entity"):
        out[i] = "done" if entities.pop(n, None) else "missing"
        for p in [p for p in relations if n in p]:
            if out[i] == "done":
                del relations[p]
    moves = pick("rename_entity", "merge_entity")
    leaving, to = {m[2] for m in moves}, {}
    for i, op, n, o, *_ in moves:
        out[i] = "missing" if n not in entities else "target moves" if o in leaving else "exists" if op == "rename_entity" and (o in entities or o in to.values()) else "done"
        if out[i] == "done":
            to[n] = o
    groups = {}
    for n, o in to.items():
        groups.setdefault(o, []).append(entities[n])
    for o, rows in groups.items():
        rows += [entities[o]] if o in entities else []
        t = filled(r[0] for r in rows)
        entities[o] = (t[0] if t else None, "\n\n".join(filled(r[1] for r in rows)), united([r[2] for r in rows], "<SEP>"))
    for n in to:
        del entities[n]
    pairs = {}
    for (a, b), row in sorted(relations.items()):
        p = tuple(sorted((to.get(a, a), to.get(b, b))))
        if p[0] != p[1]:
            pairs.setdefault(p, []).append(row)
    relations.clear()
    for p, rows in pairs.items():
        relations[p] = rows[0] if len(rows) == 1 else (united([r[0] for r in rows], ","), max(r[1] for r in rows), "\n\n".join(filled(r[2] for r in rows)), united([r[3] for r in rows], "<SEP>"))
    return out


def state(g):
    entities = {r["name"]: (r["type"], r["description"], r["source_id"]) for r in g.entities.read().collect()}
    rows = g.ends.read().collect()
    relations = {(r["a"], r["b"]): (r["keywords"], r["weight"], r["description"], r["source_id"]) for r in rows}
    assert sorted((r["node"], r["a"], r["b"]) for r in rows) == sorted((n, a, b) for a, b in relations for n in (a, b))
    return entities, relations


def graph(spark):
    g = GraphEditor(spark, f"{shared_dir(spark)}/edits-{uuid.uuid4().hex}", 4)
    names = [f"n{i}" for i in range(14)]
    entities = {n: (f"t{i % 3}" if i % 4 else "", f"about {n}", f"s{i}<SEP>s{i + 1}") for i, n in enumerate(names)}
    relations = {tuple(sorted((f"n{i}", f"n{j}"))): (f"k{i},k{j}", float(i + j), f"{i}-{j}", f"r{i}") for i in range(14) for j in (i + 1, i + 3, 0) if i < j < 14}
    g.load(spark.createDataFrame([(n, *v) for n, v in entities.items()], "name string, type string, description string, source_id string"),
           spark.createDataFrame([(*p, *v) for p, v in relations.items()], "a string, b string, keywords string, weight double, description string, source_id string"))
    assert state(g) == (entities, relations)
    return g, entities, relations


def test_batches_as_by_hand(spark):
    g, entities, relations = graph(spark)
    rng = random.Random(3)
    for batch in range(2):
        name = lambda: rng.choice([f"n{rng.randrange(17)}"] * 12 + [None, " ", "x"])  # noqa: E731, B023
        edits = [(i, rng.choice([*OPS * 3, "paint", None]), name(), name(), rng.choice([None, "t9"]), rng.choice([None, f"d{i}", ""]), rng.choice([None, "k9,k1"]), rng.choice([None, 7.5]), rng.choice([None, "s99"])) for i in range(30)]
        edits += [(99, "rename_entity", "n0", "z0", *[None] * 5), (100, "merge_entity", "n1", "n10", *[None] * 5)]
        done = g.apply(f"b{batch}", spark.createDataFrame(edits, EDIT))
        expected = by_hand(entities, relations, edits)
        assert {r["edit_id"]: r["outcome"] for r in done.collect()} == expected
        assert state(g) == (entities, relations)
    again = g.entities.versions()
    g.apply("b1", spark.createDataFrame(edits, EDIT))
    assert g.entities.versions() == again
    vectors = {r["vid"]: r["content"] for r in g.vectors.read().collect()}
    texts = [f"{n}\n{v[1]}" for n, v in entities.items()] + [f"{a}\t{b}\n{v[0]}\n{v[2]}" for (a, b), v in relations.items()]
    assert sorted(vectors.values()) == sorted(texts)


def test_info_and_empty_batch(spark):
    g, entities, relations = graph(spark)
    assert g.apply("none", spark.createDataFrame([], EDIT)).count() == 0
    assert state(g) == (entities, relations)
    info = {r["name"]: r for r in g.entity_info(spark.createDataFrame([("n0",), ("gone",), (None,), ("n0",)], "name string"), vectors=True).collect()}
    assert set(info) == {"n0", "gone"} and info["gone"]["description"] is None and info["gone"]["v"] is None
    assert info["n0"]["degree"] == sum("n0" in p for p in relations) and info["n0"]["content"] == "n0\nabout n0" and len(info["n0"]["v"]) == 16
    (r,) = g.relation_info(spark.createDataFrame([("n1", "n0"), ("n0", "n1")], "a string, b string"), vectors=True).collect()
    assert (r["a"], r["b"], r["weight"], r["content"]) == ("n0", "n1", 1.0, "n0\tn1\nk0,k1\n0-1")
