"""Suffix-array dedup: bytes covered by 50-byte strings that start in a document with a smaller id.

Prefix doubling over sampled suffixes. A round-0 sample holds, for each 50-byte string, the
position of its least 16-byte gram (by hash), so equal strings sample equal places. Positions
are dealt by rank (the gram's name) and those whose name is unique among different texts leave.
Around the others the strings that chose them are ranked at growing offsets: names of 16, of 32
and of 50 bytes, each from the pair of names half a length apart, sorted and ranked again, and a
string leaves once it is unique. What still shares a name at 50 bytes is equal, and all but the
least document of a name lose the bytes. Names are 64-bit fingerprints: only equality matters.

A full suffix sort would move each byte's position in every round; sampled ones are one in
eighteen, and most leave in the first. Before anything is shuffled, a task answers what it can:
grams that it sees in two texts are repeated, and of equal stretches in a block only the least
document's travels. So a common line costs a row a task or block, not one a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.hashing import _BASE, _BYTE, _INVERSE, _power, chunks, mix, squeeze, unsqueeze
from lakeloom.session import discard, materialize

#: Length of a repeated string, of a gram, and the grams of a string.
LENGTH, GRAM = 50, 16
STARTS = LENGTH - GRAM + 1
#: Bytes of text in a block of documents (and, of sampled text, in a bucket of names).
BLOCK_BYTES = 4_000_000


class _Names:
    """Fingerprints of stretches of a buffer."""

    def __init__(self, data: np.ndarray) -> None:
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * _power("up", _BASE, len(data)), dtype=np.uint64)])
        self.down = _power("down", _INVERSE, max(1, len(data)))

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        return mix((self.total[at + length] - self.total[at]) * self.down[at])


_PLACE = 21  # bits of a place in a chunk; longer texts are sampled in overlapping parts


def sample(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions of a chunk: (position, name, text number, first and last start of the strings that chose it)."""
    part = 2**_PLACE - 2 * LENGTH
    if len(data) > part:
        out, first, n = [], 0, len(offsets) - 1
        while first < n:  # whole texts together; a longer one in parts counted from its own start, as anywhere
            end = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + part, "right")) - 1))
            i, j = int(offsets[first]), int(offsets[end])
            if j - i <= part:
                p, name, text, lo, hi = sample(data[i:j], offsets[first : end + 1] - i)
                out.append((p + i, name, text + first, lo + i, hi + i))
            else:
                for k in range(i, j, part):
                    stop = min(k + part + LENGTH - 1, j)
                    p, name, _, lo, hi = _sample(data[k:stop], np.array([0, stop - k]))
                    out.append((p + k, name, np.full(len(p), first), lo + k, hi + k))
            first = end
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
    return _sample(data, offsets)


def _sample(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    zero = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return zero, zero.astype(np.uint64), zero, zero, zero
    name = _Names(data).of(np.arange(len(data) - GRAM + 1), GRAM)
    n, w = len(name), STARTS
    mask = np.uint64(2**_PLACE - 1)
    key = (name & ~mask) | np.arange(n, dtype=np.uint64)  # of equal grams the first
    padded = np.concatenate([key, np.full(-n % w, np.uint64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()  # least key of a window: minima of blocks from both sides
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - w + 1)
    place = (np.minimum(behind[starts], ahead[starts + w - 1]) & mask).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[starts]
    whole = starts + LENGTH <= offsets[text + 1]
    starts, place, text = starts[whole], place[whole], text[whole]
    if not len(starts):
        return zero, zero.astype(np.uint64), zero, zero, zero
    first = np.nonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))[0]
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    return place[first], name[place[first]], text[first], starts[first], starts[last]


def _pack(rows: DataFrame, blocks: int) -> DataFrame:
    """rows(id, h, text) as compressed groups of texts by block."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            by: dict[int, list[tuple]] = {}
            for r in waiting:
                by.setdefault(r[3], []).append(r)
            blobs = []
            for rs in by.values():
                meta = np.array([[r[0], r[1], len(r[2])] for r in rs], np.int64).T
                blobs.append(squeeze(np.frombuffer(b"".join([r[2] for r in rs]), np.uint8), np.ascontiguousarray(meta)))
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(by), pa.int64()), pa.array(blobs, pa.binary())], names=["block", "blob"])

        for b in it:
            texts = [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
            for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, _block_of(b.column(0).to_numpy(zero_copy_only=False), blocks).tolist(), strict=True):
                waiting.append(r)
                size += len(r[2])
                if size > 4 * BLOCK_BYTES:
                    yield flush()
                    size = 0
        if waiting:
            yield flush()

    return rows.select("id", "h", "text").mapInArrow(run, "block long, blob binary")


def _unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's rows: ids, text hashes, bytes, offsets; texts by (id, hash)."""
    parts = [unsqueeze(b, np.uint8, np.int64) for b in t.column("blob").to_pylist()]
    meta = np.concatenate([p[1].reshape(3, -1) for p in parts], axis=1)
    data = np.concatenate([p[0] for p in parts])
    at = np.concatenate([[0], np.cumsum(meta[2])])
    order = np.lexsort((meta[1], meta[0]))
    data = np.concatenate([data[at[i] : at[i + 1]] for i in order]) if len(order) else data
    return meta[0][order], meta[1][order], data, np.concatenate([[0], np.cumsum(meta[2][order])])


def _repeated(names: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Which entries have a name that another entry of a different text has."""
    order = np.lexsort((texts, names))
    n, t = names[order], texts[order]
    new = np.concatenate([[True], n[1:] != n[:-1]])
    group = np.cumsum(new) - 1
    start = np.nonzero(new)[0]
    end = np.concatenate([start[1:], [len(n)]]) - 1
    out = np.empty(len(n), bool)
    out[order] = (t[start] != t[end])[group]
    return out


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts key, bounds of its runs of equals)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    return order, np.concatenate([np.nonzero(np.concatenate([[True], k[1:] != k[:-1]]))[0], [len(k)]])


def _first_round(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, blob of ids, text hashes, sample numbers): sampled positions whose name two different texts have.

    Of equal texts, only the least document is listed.
    """

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, h, name, number = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            order = np.lexsort((ids, h, name))  # a name once for each text, with its least document
            ids, h, name, number = ids[order], h[order], name[order], number[order]
            # places of one document that share a name all stay; a copy's go
            least = np.maximum.accumulate(np.where(np.concatenate([[True], (name[1:] != name[:-1]) | (h[1:] != h[:-1])]), np.arange(len(ids)), 0))
            keep = ids == ids[least]
            ids, h, name, number = ids[keep], h[keep], name[keep], number[keep]
            known = _repeated(name, h)
            kinds, keys, blobs = [], [], []
            at = np.nonzero(known)[0]
            if len(at):
                block = _block_of(ids[at], blocks)
                order, cut = _groups(block)
                for i, j in zip(cut, cut[1:]):
                    x = at[order[i:j]]
                    kinds.append(1)
                    keys.append(int(block[order[i]]))
                    blobs.append(squeeze(ids[x], h[x], number[x].astype(np.uint32)))
            first = np.concatenate([[True], name[1:] != name[:-1]])
            at = np.nonzero(~known | first)[0]  # of a repeated name, one entry asks for the others
            bucket = (name[at] % np.uint64(blocks)).astype(np.int64)
            order, cut = _groups(bucket)
            for i, j in zip(cut, cut[1:]):
                x = at[order[i:j]]
                x = x[np.lexsort((number[x], h[x], ids[x]))]
                doc = np.concatenate([[True], (ids[x][1:] != ids[x][:-1]) | (h[x][1:] != h[x][:-1])])
                runs = np.diff(np.concatenate([np.nonzero(doc)[0], [len(x)]]))
                step = np.where(doc, number[x], number[x] - np.concatenate([[0], number[x][:-1]]))
                kinds.append(0)
                keys.append(int(bucket[order[i]]))
                blobs.append(squeeze(ids[x][doc], h[x][doc], runs.astype(np.uint32), step.astype(np.uint32), (name[x] // np.uint64(blocks)).astype(np.uint32), known[x]))
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["kind", "key", "blob"])

        for b in it:
            all_ids, all_h = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, _, data, offsets in chunks(b.column(2)):
                place, name, text, _, _ = sample(data, offsets)
                if len(place):
                    head = np.searchsorted(text, np.arange(len(offsets) - 1))
                    waiting.append((all_ids[first + text], all_h[first + text], name, np.arange(len(place)) - head[text]))
                    size += len(data)
                if size > 24 * 2**20:
                    yield flush()
                    size = 0
        if waiting:
            yield flush()

    def answer(t: pa.Table) -> pa.Table:
        if t.column("kind")[0].as_py() == 1:
            return t.select(["key", "blob"]).rename_columns(["block", "blob"])
        ids, h, number, name, known = [], [], [], [], []
        for blob in t.column("blob").to_pylist():
            i, x, runs, step, n, k = unsqueeze(blob, np.int64, np.int64, np.uint32, np.uint32, np.uint32, bool)
            ids.append(np.repeat(i, runs))
            h.append(np.repeat(x, runs))
            total = np.cumsum(step.astype(np.int64))
            start = np.concatenate([[0], np.cumsum(runs)[:-1]]).astype(np.int64)
            number.append(total - np.repeat(total[start] - step[start], runs))
            name.append(n)
            known.append(k)
        ids, h, number, name, known = (np.concatenate(x) for x in (ids, h, number, name, known))
        order = np.lexsort((ids, h, name))
        ids, h, number, name, known = (x[order] for x in (ids, h, number, name, known))
        # a name is repeated too if a task saw it in two texts, though the entry that says so may be a copy that goes
        new = np.concatenate([[True], name[1:] != name[:-1]])
        seen = np.logical_or.reduceat(known, np.nonzero(new)[0])[np.cumsum(new) - 1]
        least = np.maximum.accumulate(np.where(np.concatenate([[True], (name[1:] != name[:-1]) | (h[1:] != h[:-1])]), np.arange(len(ids)), 0))
        keep = ids == ids[least]
        ids, h, number, name, known, seen = (x[keep] for x in (ids, h, number, name, known, seen))
        at = np.nonzero((_repeated(name, h) | seen) & ~known)[0]
        block = _block_of(ids[at], blocks)
        order, cut = _groups(block)
        own, blobs = [], []
        for i, j in zip(cut, cut[1:]) if len(at) else []:
            x = at[order[i:j]]
            own.append(int(block[order[i]]))
            blobs.append(squeeze(ids[x], h[x], number[x].astype(np.uint32)))
        return pa.table({"block": pa.array(own, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    asked = rows.select("id", "h", "text").mapInArrow(ask, "kind int, key long, blob binary")
    return asked.groupBy("kind", "key").applyInArrow(answer, "block long, blob binary")


def _block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(blocks)).astype(np.int64)


def _runs(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of consecutive numbers."""
    new = np.concatenate([[True], start[1:] != start[:-1] + 1])
    first = np.nonzero(new)[0]
    return start[first], start[np.concatenate([first[1:], [len(start)]]) - 1]


def _later_rounds(packed: DataFrame, listed: DataFrame, blocks: int) -> DataFrame:
    """(block, blob of ids, text hashes, first and end of covered runs of bytes)."""

    def stretch(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"kind": [], "key": [], "blob": []}
        if len(left) and len(right):
            ids, h, data, offsets = _unpack(left)
            want = [np.concatenate(x) for x in zip(*[unsqueeze(b, np.int64, np.int64, np.uint32) for b in right.column("blob").to_pylist()], strict=True)]
            place, name, text, lo, hi = sample(data, offsets)
            head = np.searchsorted(text, np.arange(len(offsets)))
            listed = np.zeros(len(place), bool)
            order = np.lexsort((want[1], want[0]))
            wi, wh, wn = (x[order] for x in want)
            doc = np.concatenate([[True], (wi[1:] != wi[:-1]) | (wh[1:] != wh[:-1])])
            bounds = np.concatenate([np.nonzero(doc)[0], [len(wi)]])
            where = {key: t for t, key in reversed(list(enumerate(zip(ids.tolist(), h.tolist(), strict=True))))}
            for i, j in zip(bounds, bounds[1:]):
                t = where.get((int(wi[i]), int(wh[i])))
                if t is not None:
                    listed[head[t] + wn[i:j].astype(np.int64)] = True
            at = np.nonzero(listed)[0]
            if len(at):
                lo, hi = lo[at], hi[at]
                length = hi - lo + LENGTH
                names = _Names(data)
                same = np.zeros(len(at), np.uint64)
                for n in np.unique(length):
                    x = length == n
                    same[x] = mix(names.of(lo[x], int(n)) + np.uint64(n))
                # equal stretches of a block: the least document's goes on, those of others are covered
                owner = ids[text[at]]
                order = np.lexsort((lo, owner, same))
                start = np.concatenate([[True], same[order][1:] != same[order][:-1]])
                least = owner[order][np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))]
                done, go = order[owner[order] > least], order[owner[order] == least]
                if len(done):
                    d = text[at[done]]
                    out["kind"].append(1)
                    out["key"].append(left.column("block")[0].as_py())
                    out["blob"].append(squeeze(ids[d], h[d], lo[done] - offsets[d], hi[done] + LENGTH - offsets[d]))
                bucket = (name[at[go]] % np.uint64(blocks)).astype(np.int64)
                order, cut = _groups(bucket)
                for i, j in zip(cut, cut[1:]):
                    x = go[order[i:j]]
                    d = text[at[x]]
                    piece = np.concatenate([data[a:b] for a, b in zip(lo[x], hi[x] + LENGTH)])
                    out["kind"].append(0)
                    out["key"].append(int(bucket[order[i]]))
                    out["blob"].append(squeeze(ids[d], h[d], lo[x] - offsets[d], (hi[x] + LENGTH - lo[x]).astype(np.uint16), piece))
        return pa.table(out, schema=pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("blob", pa.binary())]))

    def rank(t: pa.Table) -> pa.Table:
        if t.column("kind")[0].as_py() == 1:
            return t.select(["key", "blob"]).rename_columns(["block", "blob"])
        parts = [unsqueeze(b, np.int64, np.int64, np.int64, np.uint16, np.uint8) for b in t.column("blob").to_pylist()]
        ids, h, lo, size, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        size = size.astype(np.int64)
        begin = np.cumsum(size) - size
        count = size - LENGTH + 1
        owner = np.repeat(np.arange(len(ids)), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
        names = _Names(data)
        for offset, length in ((0, 16), (16, 16), (18, 32)):  # pairs of names: 16, then 16 + 16, then 32 and 32 at 18
            pair = names.of(at, 16) if not offset else mix(rank_of * np.uint64(_BASE) + names.of(at + offset, length))
            order, cut = _groups(pair)
            some = np.repeat(np.diff(cut) > 1, np.diff(cut))  # unique positions leave
            order = order[some]
            rank_of, at, owner = pair[order], at[order], owner[order]
        if not len(at):
            return pa.table({"block": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        order = np.lexsort((ids[owner], rank_of))
        rank_of, at, owner = rank_of[order], at[order], owner[order]
        start = np.concatenate([[True], rank_of[1:] != rank_of[:-1]])
        least = ids[owner][np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))]
        later = ids[owner] > least
        at, owner = at[later], owner[later]
        where = at - begin[owner] + lo[owner]  # in the document
        order = np.lexsort((where, h[owner], ids[owner]))
        where, owner = where[order], owner[order]
        i, x = ids[owner], h[owner]
        new = np.concatenate([[True], (i[1:] != i[:-1]) | (x[1:] != x[:-1]) | (where[1:] > where[:-1] + 1)]) if len(i) else np.zeros(0, bool)
        first = np.nonzero(new)[0]
        last = np.concatenate([first[1:], [len(i)]]) - 1 if len(i) else first
        i, x, a, b = i[first], x[first], where[first], where[last] + LENGTH
        block = _block_of(i, blocks)
        order, cut = _groups(block)
        own, blobs = [], []
        for p, q in zip(cut, cut[1:]) if len(i) else []:
            o = order[p:q]
            own.append(int(block[o[0]]))
            blobs.append(squeeze(i[o], x[o], a[o], b[o]))
        return pa.table({"block": pa.array(own, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    found = packed.groupBy("block").cogroup(listed.select(F.col("block").alias("block2"), "blob").groupBy("block2"))
    sent = found.applyInArrow(stretch, "kind int, key long, blob binary")
    return sent.groupBy("kind", "key").applyInArrow(rank, "block long, blob binary")


def _cut(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a block with their covered bytes taken out."""
    ids, h, data, offsets = _unpack(left)
    cover = np.zeros(len(data) + 1, np.int32)
    if len(right):
        i, x, a, b = (np.concatenate(y) for y in zip(*[unsqueeze(blob, np.int64, np.int64, np.int64, np.int64) for blob in right.column("blob").to_pylist()], strict=True))
        where: dict[tuple, list[int]] = {}
        for t, key in enumerate(zip(ids.tolist(), h.tolist(), strict=True)):
            where.setdefault(key, []).append(t)
        order = np.lexsort((x, i))
        i, x, a, b = i[order], x[order], a[order], b[order]
        new = np.nonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (x[1:] != x[:-1])]))[0]
        for f, e in zip(new, np.concatenate([new[1:], [len(i)]])):
            for t in where.get((int(i[f]), int(x[f])), []):  # a repeated row is cut alike
                np.add.at(cover, a[f:e] + offsets[t], 1)
                np.add.at(cover, b[f:e] + offsets[t], -1)
    gone = np.cumsum(cover)[:-1] > 0
    removed, spans, kept = [], [], []
    for t in range(len(ids)):
        g = gone[offsets[t] : offsets[t + 1]]
        removed.append(int(g.sum()))
        spans.append(int(np.count_nonzero(g[1:] & ~g[:-1])) + int(len(g) > 0 and g[0]))
        kept.append(data[offsets[t] : offsets[t + 1]][~g].tobytes())
    return pa.table({
        "id": pa.array(ids), "h": pa.array(h), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()),
        "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        "kept": pa.array(kept, pa.binary()),
    })


def suffix_dedup(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept].

    Each byte covered by a 50-byte string that also starts in a document with a smaller doc_id
    is removed; strings are those of the input, overlaps count and matches never cross documents.
    n_spans: maximal removed runs; kept: the bytes that remain. doc_id is an integer; rows with a
    null one are compared with nothing and stay whole; rows that share an id do not cover one
    another. Null and empty texts have no bytes. An equal text with a smaller id covers all of a
    text of 50 bytes or more, which is settled by a hash of the text, so copies are not read
    again. An empty table gives no rows.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(12, total // BLOCK_BYTES)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    known = rows.where("id IS NOT NULL").withColumn("h", F.xxhash64("text"))
    packed = _pack(known, blocks)
    listed = materialize(_first_round(known.where(F.octet_length("text") >= LENGTH), blocks), "suffix-sample")
    runs = materialize(_later_rounds(packed, listed, blocks), "suffix-runs")
    discard(listed)
    cut = packed.groupBy("block").cogroup(runs.select(F.col("block").alias("block2"), "blob").groupBy("block2"))
    schema = "id long, h long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    done = cut.applyInArrow(_cut, schema)
    if not with_bytes:
        done = done.drop("kept")
    digests = known.where(F.octet_length("text") >= LENGTH).select("id", "h", F.sha2("text", 256).alias("sha"))
    least = digests.groupBy("sha").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    copies = digests.join(least, "sha").where("id > least").select("id", "h").distinct().withColumn("copy", F.lit(True))
    done = done.join(copies, ["id", "h"], "left")
    whole = F.col("copy").isNotNull()
    out = done.select(
        F.col("id").alias("doc_id"), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([F.when(whole, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept")] if with_bytes else []),
    )
    zero = F.lit(0).cast("long")
    apart = rows.where("id IS NULL").select(
        F.col("id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), *([F.col("text").cast("binary").alias("kept")] if with_bytes else []),
    )
    return out.unionByName(apart)
