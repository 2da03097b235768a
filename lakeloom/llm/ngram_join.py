"""N-gram Jaccard join: token-combination prefixes, then verification.

A document's tokens are its distinct five-word shingles, in one order for all: rare ones by
hash, then frequent ones by hash. Of two documents that link, neither can miss the other on a
prefix long enough: a rare token indexes alone; frequent tokens, dealt into classes, index in
pairs of one class, for which the prefix is extended by one token a class (two sets that share
no signature share at most one prefix token of a class). What shares a signature is verified on
whole sets.

Links inside a group already joined add nothing to its component. So signatures first propose
each holder together with two leaders only, the holder with most shared tokens and one at
random; when those that link are joined, what is left are signatures that hold several
components. There every pair across components that an exact bound allows is verified, block of
holders against block of holders, signatures with much the same holders taken together: keys and
sizes travel, and a pair's sets only if it may link. Of two components the likeliest pair is
verified first, the other pairs only where that leaves the two apart. A component of more than
CROWD sets stands there as one holder, by the least and greatest of what its sets have; what may link
with any of them is then verified against all, blocks of sets against blocks of sets.
Which tokens are frequent is counted exactly, over the distinct sets of every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.hashing import chunks, mix, shingles, squeeze, trim, unsqueeze
from lakeloom.plans.components import connected_components
from lakeloom.session import discard, materialize

#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A token is frequent from this many sets on, or from a 2**24th of all tokens (64 up to about 6 GB of text, 290 at 30 GB).
FREQUENT, MOST_FREQUENT = 64, 2**24
#: Tokens (and twice the signatures) a task gathers before it sends them, and sets it remembers so as to skip their copies.
FLUSH_ROWS, SEEN = 1_000_000, 200_000
#: Tokens or signatures a bucket holds on average, and members verified together against one set.
BUCKET_ROWS, VERIFY_ROWS = 250_000, 256
#: Words of 64 bits of the map of a set's tokens, which bounds how many two sets share.
MAP_WORDS = 8
_MAP = [f"m{i}" for i in range(MAP_WORDS)]
#: Bits of a token that its bucket and the next 24 leave out, and the bucket's.
_SHORT = 64 - 24
#: Holders in a block when those of one bundle of signatures are compared across components.
ACROSS_ROWS = 512
#: Sets of a component up to which each of them meets others by itself.
CROWD = 8
#: Words of 64 bits, one bit a signature, of which of a bundle's signatures a set holds; what names a bundle.
HELD_WORDS = 4
_HELD, _BUNDLE = [f"h{i}" for i in range(HELD_WORDS)], ("single", "lead", "piece", "more")
#: Bits of the maps of wanted documents (eight each) and frequent tokens, within these bounds (32 MB at most, as they are broadcast).
LEAST_PLACES, MOST_PLACES = 2**15, 2**28


def _keys(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for salt in (0x51ED270B9C3E2A75, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(mix(total[at[1:]] - total[at[:-1]] + (at[1:] - at[:-1]).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _sets(docs: DataFrame, bits: int) -> DataFrame:
    """kind 0: (doc_id, n, lo, hi) of each document; kind 1: (lo: bucket, blob) of tokens and in how many of a task's distinct sets they are.

    A token's bucket is its first ``bits`` bits; the blob holds the next 24, sorted, as differences,
    byte by byte. Tokens that agree in all these are counted together; that moves no result.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        waiting: list[np.ndarray] = []
        names, ids, size = ["kind", "doc_id", "n", "lo", "hi", "blob"], pa.int64(), 0

        def flush() -> pa.RecordBatch:
            t, c = np.unique(np.concatenate(waiting) >> np.uint64(_SHORT - bits), return_counts=True)
            waiting.clear()
            own, first = np.unique(t >> np.uint64(24), return_index=True)
            step = np.diff(t, prepend=np.uint64(0)).astype(np.uint32)
            step[first] = t[first] & np.uint64(2**24 - 1)
            cut = [*first.tolist(), len(t)]
            blobs = [squeeze(np.ascontiguousarray(step[i:j].view(np.uint8).reshape(-1, 4).T), np.minimum(c[i:j], 2**32 - 1).astype(np.uint32)) for i, j in zip(cut, cut[1:])]
            none = pa.nulls(len(own), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(own), np.int32)), pa.nulls(len(own), ids), none, pa.array(own.view(np.int64)), none, pa.array(blobs, pa.binary())], names=names)

        for b in it:
            ids = b.schema.field(0).type
            for first, end, data, offsets in chunks(b.column(1)):
                tokens, at = shingles(data, offsets)
                lo, hi = _keys(tokens, at)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(end - first, np.int32)), b.column(0).slice(first, end - first), pa.array(np.diff(at)), pa.array(lo), pa.array(hi), pa.nulls(end - first, pa.binary())], names=names)
                for k, key in enumerate(lo.tolist()):
                    if at[k] < at[k + 1] and not (key in seen or seen.add(key)):
                        waiting.append(tokens[at[k] : at[k + 1]])
                        size += len(waiting[-1])
                if len(seen) > SEEN:
                    seen.clear()
                if size > FLUSH_ROWS:
                    yield flush()
                    size = 0
        if size:
            yield flush()
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, f"kind int, doc_id {id_type}, n long, lo long, hi long, blob binary")


def _frequent(counted: DataFrame, often: int, places: int) -> DataFrame:
    """(place) in a map of that many bits of each token, by its bucket and next 24 bits, that is in ``often`` distinct sets or more."""

    def run(t: pa.Table) -> pa.Table:
        parts = [unsqueeze(b, np.uint8, np.uint32) for b in t.column("blob").to_pylist()]
        steps = [np.ascontiguousarray(p[0].reshape(4, -1).T).view(np.uint32).ravel() for p in parts]
        token, at = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in steps]), return_inverse=True)
        n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(token))
        kept = token[n >= often] | np.uint64(t.column("lo")[0].as_py() << 24)
        return pa.table({"place": pa.array(_places(kept, places))})

    return counted.select("lo", "blob").groupBy("lo").applyInArrow(run, "place long")


def _places(tokens: np.ndarray, places: int) -> np.ndarray:
    return (mix(tokens) % np.uint64(places)).astype(np.int64)


def _frequent_map(counted: DataFrame, total: int) -> np.ndarray:
    """The map of frequent tokens, of bounded size: 16 bits or more for each there can be, 32 MB at most.

    A rare token whose place is taken counts as frequent in every set alike, so no link is lost.
    """
    often = max(FREQUENT, total // MOST_FREQUENT)
    places = min(MOST_PLACES, max(LEAST_PLACES, 1 << (16 * total // often).bit_length()))
    at = _frequent(counted, often, places).select((F.col("place") + 1).alias("place"))
    rows = at.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    out = np.zeros((places // (8 * 4096), 4096), np.uint8)
    for r in rows:
        out[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def bit_map(tokens: np.ndarray) -> np.ndarray:
    """64 * MAP_WORDS bits, set at the tokens' hashes, as signed words: a bit that only one of two sets has is a token that only it has."""
    place = (mix(tokens) % np.uint64(64 * MAP_WORDS)).astype(np.int64)
    bits = np.zeros(64 * MAP_WORDS, np.uint8)
    bits[place] = 1
    return np.packbits(bits).view(np.int64)


def prefix_signatures(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures of single rare tokens, signatures of pairs of frequent ones) of one set.

    tokens: distinct, sorted; frequent: which of them are.
    """
    n = len(tokens)
    need = n - -(-n * PERCENT // 100) + 1
    rare, rest = tokens[~frequent], tokens[frequent]
    if len(rare) >= need or n < 2:  # a set of one token links with equal sets only
        return rare[:need], np.zeros(0, np.uint64)
    out = []
    for level in {int(n).bit_length(), int(-(-n * 100 // PERCENT)).bit_length()}:  # two sets that link share one
        classes = max(1, 2 ** (level - 1) // 16)
        of = (mix(rest ^ np.uint64(level)) % np.uint64(classes)).astype(np.int64)
        opens = np.zeros(len(rest), bool)
        opens[np.unique(of, return_index=True)[1]] = True
        enough = np.nonzero(np.cumsum(~opens) >= need - len(rare))[0]
        used = enough[0] + 1 if len(enough) else len(rest)
        order = np.argsort(of[:used], kind="stable")
        of, taken = of[:used][order], rest[:used][order]
        for gap in range(1, used):  # neighbours of a class at each distance
            same = of[gap:] == of[:-gap]
            if not same.any():
                break
            out.append(mix(taken[:-gap][same] * np.uint64(0x9E3779B97F4A7C15) + mix(taken[gap:][same] + np.uint64(level))))
    return rare, np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets_of(b: pa.RecordBatch, frequent: np.ndarray, bits: int, seen: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Key, tokens, and which of them are frequent, of the sets of a batch (texts in column 0) that the task has not seen."""
    for _, _, data, offsets in chunks(b.column(0)):
        tokens, at = shingles(data, offsets)
        lo, _ = _keys(tokens, at)
        short = tokens >> np.uint64(_SHORT - bits)
        place = _places(short, 8 * len(frequent))
        often = (frequent[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        if len(seen) > SEEN:
            seen.clear()
        for i, key in enumerate(lo.tolist()):
            if at[i] < at[i + 1] and key not in seen:
                seen.add(key)
                yield key, tokens[at[i] : at[i + 1]], often[at[i] : at[i + 1]]


def _pair_signatures(docs: DataFrame, frequent: Broadcast, bits: int) -> DataFrame:
    """(sig, key) for each indexed pair of frequent tokens, and for each set one row (key, rest, end, bit map) without a sig.

    rest: the set's tokens after its prefix of rare ones; end: the last token of that prefix, as a
    signed number in the same order, the largest number where the prefix holds all rare tokens.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in it:
            keys, rests, ends, maps = [], [], [], []
            for key, tokens, often in _sets_of(b, frequent.value, bits, seen):
                one, two = prefix_signatures(tokens, often)
                keys.append(key)
                rests.append(len(tokens) - len(one))
                ends.append(2**63 - 1 if often.sum() == rests[-1] else int(one[-1]) - 2**63)
                maps.append(bit_map(tokens) if len(two) else None)
                if len(two):
                    none = pa.nulls(len(two), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(two.view(np.int64)), pa.array(np.full(len(two), key, np.int64)), none, none, *[none] * MAP_WORDS], names=["sig", "key", "rest", "end", *_MAP])
            none = pa.nulls(len(keys), pa.int64())
            words = [pa.array([None if m is None else int(m[i]) for m in maps], pa.int64()) for i in range(MAP_WORDS)]
            yield pa.RecordBatch.from_arrays([none, pa.array(keys, pa.int64()), pa.array(rests, pa.int64()), pa.array(ends, pa.int64()), *words], names=["sig", "key", "rest", "end", *_MAP])
        trim()

    return docs.select("text").mapInArrow(run, "sig long, key long, rest long, end long, " + ", ".join(f"{m} long" for m in _MAP))


def _single_signatures(docs: DataFrame, frequent: Broadcast, bits: int, buckets: int) -> DataFrame:
    """Rows of packed signatures of rare tokens by bucket."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        keys: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            s, k = np.concatenate([*sigs, np.zeros(0, np.uint64)]), np.concatenate([*keys, np.zeros(0, np.int64)])
            b = (s % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            s, k = (s[order] // np.uint64(buckets)).astype(np.uint32), k[order]  # the bucket and 32 more bits
            own, first = np.unique(b[order], return_index=True)
            cut = [*first.tolist(), len(s)]
            sigs.clear()
            keys.clear()
            blobs = [pa.array([x[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()) for x in (s, k)]
            return pa.RecordBatch.from_arrays([pa.array(own), *blobs], names=["bucket", "sigs", "keys"])

        rows = 0
        for b in it:
            for key, tokens, often in _sets_of(b, frequent.value, bits, seen):
                one, _ = prefix_signatures(tokens, often)
                sigs.append(one)
                keys.append(np.full(len(one), key, np.int64))
                rows += len(one)
                if rows > FLUSH_ROWS // 2:
                    yield flush()
                    rows = 0
        if sigs:
            yield flush()
        trim()

    return docs.select("text").mapInArrow(run, "bucket long, sigs binary, keys binary")


def _shared_singles(packed: DataFrame, buckets: int) -> DataFrame:
    """(sig, key) of the single-token signatures that two sets or more hold. Rare tokens: a bucket stays small."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        s = np.frombuffer(b"".join(t.column("sigs").to_pylist()), np.uint32)
        k = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64)
        order = np.lexsort((k, s))  # copies that several tasks met come together
        s, k = s[order], k[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])])
        s, k = s[new], k[new]
        same = s[1:] == s[:-1]
        near = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        return pa.table({"sig": pa.array(s[near].astype(np.int64) * buckets + bucket), "key": pa.array(k[near])})

    return packed.groupBy("bucket").applyInArrow(run, "sig long, key long")


def _candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, n, tokens) of the wanted(doc_id, key, hi); tokens are packed 64-bit hashes, sorted."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in it:
            want_lo, want_hi = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for first, end, data, offsets in chunks(b.column(0)):
                tokens, at = shingles(data, offsets)
                lo, hi = _keys(tokens, at)
                ok = np.nonzero((lo == want_lo[first:end]) & (hi == want_hi[first:end]))[0]
                ok = np.array([i for i in ok if not (int(hi[i]) in seen or seen.add(int(hi[i])))], np.int64)  # a row repeated
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lo[ok]), pa.array(np.diff(at)[ok]), pa.array([tokens[at[i] : at[i + 1]].tobytes() for i in ok], pa.binary())], names=["key", "n", "tokens"]
                )
        trim()

    rows = docs.select("doc_id", "text").join(wanted.hint("shuffle_hash"), "doc_id").select("text", "key", "hi")
    return rows.mapInArrow(run, "key long, n long, tokens binary")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs(a, b), those that link. A set that meets many others does so in groups of about VERIFY_ROWS."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        for t in left.column("tokens").to_pylist():
            x = np.frombuffer(t, np.uint64)
            for other, u in zip(right.column("b").to_pylist(), right.column("members").to_pylist(), strict=True):
                y = np.frombuffer(u, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= PERCENT * (len(both) - common):
                    a.append(key[0].as_py())
                    b.append(other)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / VERIFY_ROWS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    right = dealt.select(F.col("a").alias("a2"), F.col("part").alias("part2"), "b").join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("members")), "b")
    left = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left = left.join(sets.select(F.col("key").alias("a"), "tokens"), "a")
    return left.groupBy("a", "part").cogroup(right.groupBy("a2", "part2")).applyInArrow(run, "a long, b long")


_PAIR = ("a", "b", "na", "nb", "rest")


def _may_link(shared: Column, tops: tuple[str, str] = ("na", "nb")) -> Column:
    """Whether sets a and b with at most ``shared`` signatures of rare tokens in common can link.

    Of a crowd, na or nb is its least size and tops names its greatest.

    Up to where the first of the two prefixes ends, the common tokens are exactly the shared
    signatures; after it at most that set's rest is common. So the intersection is at most the
    shared ones plus that rest, and must reach 75 / 175 of both sizes (na, nb).
    """
    na, nb = F.col("na").cast("long"), F.col("nb").cast("long")
    fits = (100 * F.col(tops[0]).cast("long") >= PERCENT * nb) & (100 * F.col(tops[1]).cast("long") >= PERCENT * na)
    return fits & ((100 + PERCENT) * (shared + F.col("rest").cast("long")) >= PERCENT * (na + nb))


def _first_rest() -> Column:
    """The rest of the set whose prefix ends first."""
    return F.when(F.col("ea") < F.col("eb"), F.col("sa")).when(F.col("ea") > F.col("eb"), F.col("sb")).otherwise(F.least("sa", "sb"))


def _can_link(pairs: DataFrame, singles: DataFrame) -> DataFrame:
    """Pairs (a, b) that may link by the signatures they really share."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    held = singles.join(keys, "key", "left_semi").groupBy("key").agg(F.collect_list("sig").alias("held"))
    p = pairs.join(held.select(F.col("key").alias("a"), F.col("held").alias("ha")), "a", "left")
    p = p.join(held.select(F.col("key").alias("b"), F.col("held").alias("hb")), "b", "left")
    shared = F.coalesce(F.size(F.array_intersect("ha", "hb")), F.lit(0))
    return p.where(_may_link(shared)).select("a", "b")


def _near_wanted(docs: DataFrame, wanted: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, text) of docs, without most of those whose doc_id is not in wanted, so that their texts are not shuffled.

    A map has a bit for each hash of a wanted doc_id. It is of bounded size: where documents are
    many for it, more that nobody wants pass, and the join that follows drops them.
    """
    places = min(MOST_PLACES, max(LEAST_PLACES, 1 << (8 * n_docs).bit_length()))
    place = (F.pmod(F.xxhash64("doc_id"), F.lit(places).cast("long")) + 1).alias("place")
    bits = wanted.select(place).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    d = docs.select("doc_id", "text", place)
    d = d.select("doc_id", "text", F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").cast("int").alias("at"))
    of_bit = F.expr("shiftright(cast(conv(hex(substring(bits, at div 8 + 1, 1)), 16, 10) AS int), at % 8) & 1 = 1")
    return d.join(F.broadcast(bits), "bucket").where(of_bit).select("doc_id", "text")


def _sets_for(docs: DataFrame, own: DataFrame, wanted: DataFrame) -> DataFrame:
    """Token sets of the wanted(key), each read from one document that has it."""
    reps = own.where("n_shingles > 0").groupBy("key", "hi").agg(F.min("doc_id").alias("doc_id")).join(wanted.distinct(), "key")
    reps = materialize(reps.select("doc_id", "key", "hi"), "ngram-reps")
    sets = materialize(_candidate_sets(_near_wanted(docs, reps, own.count()), reps), "ngram-tokens")
    discard(reps)
    return sets


def _side(postings: DataFrame, e: str, keep: list) -> DataFrame:
    """Postings as one side, a or b, of a pair."""
    return postings.select(*keep, *[F.col(c).alias(x + e) for c, x in (("key", ""), ("n", "n"), ("rare", "r"), ("rest", "s"), ("end", "e"))])


def _maps_allow() -> Column:
    """Whether sets a and b can link by their bit maps: each shares at most its size less the bits that only it has.

    A crowd's map has the bits of all its sets, so only a set is held against it.
    """

    def most(x: str, y: str) -> Column:
        own = sum((F.bit_count(F.col(m + x).bitwiseAND(F.bitwise_not(F.col(m + y)))) for m in _MAP), F.lit(0))
        return F.when(F.col("crowd" + x), F.col("top" + x).cast("long")).otherwise(F.col("n" + x).cast("long") - own)

    return (100 + PERCENT) * F.least(most("a", "b"), most("b", "a")) >= PERCENT * (F.col("na").cast("long") + F.col("nb"))


def _with_leaders(postings: DataFrame) -> DataFrame:
    """_PAIR of each set with two leaders.

    A signature has two: the holder with most shared tokens, and one at random. Of each kind a set
    takes the leader that most of its signatures propose, so there are two pairs a set at most.
    """
    share = F.col("rare") / F.greatest(F.col("n") - F.col("rest"), F.lit(1))
    lead = [F.struct(share.cast("float").alias("p"), "key"), F.struct(F.xxhash64("key", F.lit(1)).alias("p"), "key")]
    leaders = postings.groupBy("sig").agg(*[F.max(x)["key"].alias(f"x{k}") for k, x in enumerate(lead)])
    proposed = postings.select("sig", F.col("key").alias("b")).join(leaders, "sig").select("b", F.posexplode(F.array("x0", "x1")).alias("kind", "a")).where("a <> b")
    best = proposed.groupBy("b", "kind", "a").count().groupBy("b", "kind").agg(F.max(F.struct("count", "a"))["a"].alias("a"))
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = postings.select("key", "n", "rare", "rest", "end").distinct()
    pairs = best.join(_side(sets, "a", []), "a").join(_side(sets, "b", []), "b").withColumn("rest", _first_rest())
    return pairs.where(_may_link(F.least("ra", "rb"))).select(*_PAIR)


def _bundles(postings: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bundle..., key, blocks, maps of signatures held) of signatures that several parts hold; (key, sizes, bit map, part) of all holders; a table that the first reads.

    Holders are sets, and the parts of more than CROWD sets: of these, key is the part, n and top are the least and
    greatest size, end and last likewise, rare and rest the greatest, and the maps have the bits of all.

    Near copies share most of their signatures, so those that sets of one part (pairs) or one set
    (single tokens) hold go in bundles of up to 64 * HELD_WORDS, each holder with one bit for each: a
    pair of holders then meets once a bundle and not once a signature. Where the holders of a
    lead's signatures have less in common, so that there would be more pairs than before, each
    signature is a bundle of its own.
    """
    big = parts.groupBy("component").agg(F.count("*").alias("members"))
    sets = postings.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "rare", "rest", "end")], *[F.max(m).alias(m) for m in _MAP])
    sets = sets.join(parts.join(big, "component"), "key", "left").withColumn("part", F.coalesce("component", "key"))
    sets = sets.withColumn("members", F.coalesce("members", F.lit(1))).withColumn("crowd", F.col("members") > CROWD).drop("component")
    sets = materialize(sets.withColumn("holder", F.when(F.col("crowd"), F.col("part")).otherwise(F.col("key"))), "ngram-parted")
    label = postings.select("single", "sig", "key").join(sets.select("key", "holder", "part", "members"), "key")
    label = label.select("single", "sig", F.col("holder").alias("key"), "part", "members").distinct()
    ends = [f("end").alias(c) for f, c in ((F.min, "end"), (F.max, "last"))]
    sizes = [F.min("n").alias("n"), F.max("n").alias("top"), F.max("rare").alias("rare"), F.max("rest").alias("rest"), *ends]
    holders = sets.groupBy(F.col("holder").alias("key"), "part", "crowd").agg(*sizes, *[F.bit_or(m).alias(m) for m in _MAP])
    holders = materialize(holders, "ngram-holders")
    lead = F.when(F.col("single"), F.min("key")).otherwise(F.max(F.struct("members", "part"))["part"]).alias("lead")
    sigs = label.groupBy("single", "sig").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("holders"), lead).where("x < y").drop("x", "y")
    held = materialize(label.select("single", "sig", "key").join(sigs, ["single", "sig"]), "ngram-held")
    of_lead = held.groupBy("single", "lead", "key").agg(F.sum("holders").alias("meet"), F.sum(1 / F.col("holders")).alias("sigs"))
    of_lead = of_lead.groupBy("single", "lead").agg(F.count("*").alias("together"), F.sum("meet").alias("meet"), F.sum("sigs").alias("sigs"))
    sigs = held.select("single", "sig", "holders", "lead").distinct().join(of_lead, ["single", "lead"])
    fits = F.col("together").cast("double") * F.col("together") <= 4 * F.col("meet")
    piece = F.pmod(F.xxhash64("sig"), F.ceil(F.col("sigs") / (32 * HELD_WORDS))).cast("long")  # half full on average
    sigs = sigs.select("single", "sig", F.ceil(F.when(fits, F.col("together")).otherwise(F.col("holders")) / ACROSS_ROWS).cast("int").alias("blocks"), F.when(fits, F.col("lead")).otherwise(F.col("sig")).alias("lead"), F.when(fits, piece).otherwise(-1).alias("piece"))
    place = F.row_number().over(W.partitionBy("single", "lead", "piece").orderBy("sig")) - 1
    sigs = sigs.withColumn("place", place).withColumn("more", F.floor(F.col("place") / (64 * HELD_WORDS)))
    at = F.col("place") % (64 * HELD_WORDS)
    bits = [F.bit_or(F.when(F.floor(at / 64) == i, F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(h) for i, h in enumerate(_HELD)]
    bundled = held.select("single", "sig", "key").join(sigs, ["single", "sig"]).groupBy(*_BUNDLE, "key", "blocks").agg(*bits)
    discard(sets)
    return bundled, holders, held


def _across(postings: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b, pa, pb, apart, crowd) of different parts, the lesser pa and pb, that share a signature and may link.

    parts(key, component) name the parts; apart estimates the share of their tokens that only one of the two has.
    Where crowd is true, a or b or both are parts of more than CROWD sets, some of which may link with the other.

    The holders of a bundle of signatures are dealt into blocks of about ACROSS_ROWS and every pair
    of blocks is a key of its own, so a frequent signature is many tasks' work; only pairs that the
    bound allows leave the join. All single signatures that two parts share are here, so their count is
    exact, and a pair that a signature of frequent tokens proposes needs to be looked at as one
    that shares no rare token: if it shares any, a single signature proposes it as well. Such pairs
    are held against the sets' bit maps too.
    """
    bundled, holders, held = _bundles(postings, parts)
    full = bundled.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).join(holders, "key")
    kept = lambda e: [F.col(c).alias(c + e) for c in (*_MAP, *_HELD, "top", "last", "crowd")]
    left = _side(full, "a", [*_BUNDLE, *kept("a"), F.col("part").alias("pa"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j")])
    right = _side(full, "b", [*_BUNDLE, *kept("b"), F.col("part").alias("pb"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), "block")).alias("i")])
    common = reduce(Column.__add__, [F.bit_count(F.col(h + "a").bitwiseAND(F.col(h + "b"))) for h in _HELD])
    pairs = left.join(right, [*_BUNDLE, "i", "j"]).where("pa <> pb AND (i < j OR a < b)").where(common > 0)
    rest = F.when(~(F.col("crowda") | F.col("crowdb")), _first_rest()).when(F.col("lasta") < F.col("eb"), F.col("sa")).when(F.col("ea") > F.col("lastb"), F.col("sb"))
    pairs = pairs.withColumn("rest", rest.otherwise(F.greatest("sa", "sb")))
    tops = ("topa", "topb")
    pairs = pairs.where(_may_link(F.when(F.col("single"), F.least("ra", "rb")).otherwise(0), tops) & (F.col("single") | _maps_allow()))
    first, last = F.col("a") < F.col("b"), {}
    for x in ("", "n", "top"):
        last |= {x + "a": F.when(first, F.col(x + "a")).otherwise(F.col(x + "b")), x + "b": F.when(first, F.col(x + "b")).otherwise(F.col(x + "a"))}
    differ = reduce(Column.__add__, [F.bit_count(F.col(m + "a").bitwiseXOR(F.col(m + "b"))) for m in _MAP]).alias("differ")
    pairs = pairs.select(*[c.alias(k) for k, c in last.items()], "rest", F.least("pa", "pb").alias("pa"), F.greatest("pa", "pb").alias("pb"), (F.col("crowda") | F.col("crowdb")).alias("crowd"), differ, F.when(F.col("single"), common).otherwise(0).alias("one"))
    pairs = pairs.groupBy(*_PAIR, *tops, "pa", "pb", "crowd").agg(F.sum("one").alias("shared"), F.min("differ").alias("differ")).where(_may_link(F.col("shared"), tops))
    sizes = F.col("na").cast("long") + F.col("nb")
    pairs = pairs.select("a", "b", "pa", "pb", (F.least("differ", sizes - 2 * F.col("shared")) / sizes).alias("apart"), "crowd")
    out = materialize(pairs, "ngram-across")
    discard(holders, held)
    return out


def _by_parts(docs: DataFrame, own: DataFrame, across: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of across(a, b, pa, pb, apart): the likeliest pair of every two parts, the other pairs of parts that these leave apart, and the links of both.

    One link joins two parts, so a set near a group of near copies need not be verified against each
    of these; every pair of sets whose parts are still apart is.
    """
    best = F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("best")
    likely = materialize(across.groupBy("pa", "pb").agg(best).select("best.a", "best.b", "pa", "pb"), "ngram-likely")
    sets = _sets_for(docs, own, likely.select(F.explode(F.array("a", "b")).alias("key")))
    joined = materialize(_verify(likely.select("a", "b"), sets), "ngram-links")
    discard(sets)
    steps = joined.join(likely, ["a", "b"]).select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    whole = materialize(connected_components(steps), "ngram-whole")
    rest = across.join(likely.select("a", "b"), ["a", "b"], "left_anti")
    for p in ("pa", "pb"):
        rest = rest.join(whole.select(F.col("id").alias(p), F.col("component").alias("in_" + p)), p, "left").withColumn("in_" + p, F.coalesce("in_" + p, p))
    rest = materialize(rest.where("in_pa <> in_pb").select("a", "b"), "ngram-pairs")
    discard(whole)
    sets = _sets_for(docs, own, rest.select(F.explode(F.array("a", "b")).alias("key")))
    more = materialize(_verify(rest, sets).unionByName(joined), "ngram-links")
    discard(sets, joined)
    return likely, rest, more


def _with_crowds(docs: DataFrame, own: DataFrame, met: DataFrame, parts: DataFrame) -> DataFrame:
    """Links (a, b) of the parts met(pa, pb): for each set of the lesser part one with a set of the greater, if there is any.

    The sets of a crowd are dealt into blocks, and those that are to meet it into others, of about VERIFY_ROWS each; every
    pair of blocks is a key of its own, in which each set is held against all of the crowd's at once.
    """

    def run(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if len(left) and len(right):
            sets = [np.frombuffer(t, np.uint64) for t in left.column("tokens").to_pylist()]
            keys, n = left.column("key").to_numpy(), np.array([len(x) for x in sets])
            tokens = np.concatenate(sets)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], np.repeat(np.arange(len(sets)), n)[order]
            for key, t in zip(right.column("b").to_pylist(), right.column("guest").to_pylist(), strict=True):
                x = np.frombuffer(t, np.uint64)
                first, end = np.searchsorted(tokens, x, "left"), np.searchsorted(tokens, x, "right")
                held = end - first
                at = np.arange(int(held.sum())) + np.repeat(first - np.cumsum(held) + held, held)
                common = np.bincount(owner[at], minlength=len(sets))
                if len(linked := np.nonzero(100 * common >= PERCENT * (n + len(x) - common))[0]):
                    a.append(int(keys[linked[0]]))
                    b.append(key)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sizes = parts.groupBy("component").agg(F.count("*").alias("members"))
    for p in ("pa", "pb"):
        met = met.join(sizes.select(F.col("component").alias(p), F.col("members").alias("of_" + p)), p, "left").fillna(1, ["of_" + p])
    larger = F.col("of_pa") >= F.col("of_pb")
    met = met.select(F.when(larger, F.col("pa")).otherwise(F.col("pb")).alias("crowd"), F.when(larger, F.col("pb")).otherwise(F.col("pa")).alias("component")).distinct()
    guests = met.join(parts, "component", "left").select("crowd", F.coalesce("key", "component").alias("key"))  # a set in no part is its own
    crowds = parts.withColumnRenamed("component", "crowd").join(met.select("crowd").distinct(), "crowd").select("crowd", "key")
    both = materialize(guests.withColumn("guest", F.lit(True)).unionByName(crowds.withColumn("guest", F.lit(False))), "ngram-meet")
    sets = _sets_for(docs, own, both.select("key"))
    blocks = both.groupBy("crowd").agg(*[F.ceil(F.count(F.when(F.col("guest") == g, 1)) / VERIFY_ROWS).cast("int").alias(c) for c, g in (("blocks", False), ("groups", True))])
    dealt = both.join(blocks, "crowd").withColumn("hash", F.xxhash64("key"))
    i, g = F.pmod("hash", F.col("blocks")).cast("int"), F.pmod("hash", F.col("groups")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("NOT guest").select("crowd", "key", i.alias("i"), every("groups").alias("g")).join(sets.select("key", "tokens"), "key")
    right = dealt.where("guest").select(F.col("crowd").alias("crowd2"), F.col("key").alias("b"), every("blocks").alias("i2"), g.alias("g2"))
    right = right.join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("guest")), "b")
    links = left.groupBy("crowd", "i", "g").cogroup(right.groupBy("crowd2", "i2", "g2")).applyInArrow(run, "a long, b long")
    out = materialize(links, "ngram-links")
    discard(both, sets)
    return out


def ngram_join(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id, set_lo, set_hi (two hashes of the set).

    Documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more link;
    component_id is the least doc_id reachable over links, the document's own included. Texts
    without words, empty or null have no shingles and stand alone, as do rows with a null doc_id
    (their component is that of the equal set's least id, null if there is none). Equal sets are
    one set throughout, so any number of copies costs no pairs. Repeated rows give repeated rows;
    an empty table gives none. Other columns are ignored.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, min(40, (size // 6 // BUCKET_ROWS).bit_length()))  # a shingle is about six bytes of text
    all_rows = materialize(_sets(docs, bits), "ngram-sets")
    own = materialize(all_rows.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("lo").alias("key"), "hi"), "ngram-own")
    total = own.agg(F.sum("n_shingles")).first()[0] or 0
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent_map(all_rows.where("kind = 1"), total))
    discard(all_rows)
    buckets = max(64, total // 4 // BUCKET_ROWS)
    singles = materialize(_shared_singles(_single_signatures(docs, frequent, bits, buckets), buckets), "ngram-singles")
    paired = materialize(_pair_signatures(docs, frequent, bits), "ngram-paired")
    held = paired.where("sig IS NOT NULL").groupBy("sig").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x < y").select("sig")
    pairs_of = paired.where("sig IS NOT NULL").select("sig", "key").join(held, "sig")
    every = singles.withColumn("single", F.lit(True)).unionByName(pairs_of.distinct().withColumn("single", F.lit(False)))
    stats = own.where("n_shingles > 0").groupBy("key").agg(F.min("n_shingles").alias("n"))
    stats = stats.join(paired.where("sig IS NULL").groupBy("key").agg(F.min("rest").alias("rest"), F.min("end").alias("end"), *[F.min(m).alias(m) for m in _MAP]), "key")
    stats = stats.join(singles.groupBy("key").agg(F.count("*").alias("rare")), "key", "left").fillna(0, ["rare"])
    sizes = [F.col(c).cast("int").alias(c) for c in ("n", "rare", "rest")]
    maps = [F.when(~F.col("single"), F.col(m)).alias(m) for m in _MAP]
    postings = materialize(every.join(stats, "key").select("sig", "single", "key", *sizes, "end", *maps), "ngram-postings")
    discard(paired)

    first = materialize(_can_link(_with_leaders(postings), singles), "ngram-pairs")
    sets = _sets_for(docs, own, first.select(F.explode(F.array("a", "b")).alias("key")))
    links = materialize(_verify(first, sets), "ngram-links")
    discard(sets, singles)
    parts = materialize(connected_components(links).withColumnRenamed("id", "key"), "ngram-parts")
    found = _across(postings, parts)
    discard(postings)
    crowded = _with_crowds(docs, own, found.where("crowd").select("pa", "pb"), parts)
    discard(parts)
    left = materialize(found.where("NOT crowd").drop("crowd").join(first, ["a", "b"], "left_anti"), "ngram-left")
    discard(found, first)
    likely, rest, more = _by_parts(docs, own, left)
    parts = materialize(connected_components(links.unionByName(crowded).unionByName(more)), "ngram-parts").withColumnRenamed("id", "key")
    discard(left, likely, rest, links, crowded, more)
    frequent.unpersist()
    sets_of = own.where("n_shingles > 0").groupBy("key", "hi").agg(F.min("doc_id").alias("least"))
    sets_of = sets_of.join(parts, "key", "left").withColumn("part", F.coalesce("component", "key"))
    # a set that no link reaches is its own component, whatever another with the same first hash is
    sets_of = sets_of.withColumn("alone", F.when(F.col("component").isNull(), F.col("hi")))
    ids = sets_of.groupBy("part", "alone").agg(F.min("least").alias("component_id"))
    ids = sets_of.join(ids, sets_of["part"].eqNullSafe(ids["part"]) & sets_of["alone"].eqNullSafe(ids["alone"])).select("key", "hi", "component_id")
    out = own.join(ids, ["key", "hi"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("key").alias("set_lo"), F.col("hi").alias("set_hi"))
