"""Byte-level BPE encoding and decoding, as recursive DuckDB queries inside each partition.

A batch's distinct words become token-position rows. A recursive query joins each row and its
right neighbour with the merge table and contracts, in every word, the leftmost pair of least
rank until no word has a pair left. Ordered aggregation gives the ids of a word, and, joined
with the vocabulary, its decoded bytes. Words are kept in a bounded dictionary between batches.
Long words are first cut where no token of the vocabulary reaches across, and pieces that stay
long take a recursion that keeps only the present tokens, so memory goes with the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakeloom.llm.hashing import trim

#: Distinct words in each of the dictionary's two generations, and characters taken into one batch.
KEPT_WORDS, BATCH_CHARS = 50_000, 400_000
#: Words over this many bytes are cut where no token of the vocabulary can reach across.
CUT_BYTES = 48
#: Pieces over this many bytes contract all occurrences of their least pair in a round, where that equals one after another.
LONG_PIECE = 96
#: Token-position rows in one recursive query (over all its rounds, for short pieces).
QUERY_ROWS = 100_000
#: Memory of a worker's DuckDB. One piece of over 800 kB, which a single row of text brings, gets 500 bytes a byte.
MEMORY_MB = 400

_RECURSIVE = """
WITH RECURSIVE t(round, word, pos, id, right_pos, right_id) AS (
  SELECT 0, word, pos, id, right_pos, right_id FROM start
  UNION ALL
  (WITH best AS (
     SELECT word, min(rank * 4294967296 + pos) AS best, arg_min(right_pos, rank * 4294967296 + pos) AS gone
     FROM t JOIN merges ON merges.l = id AND merges.r = right_id GROUP BY word),
   pair AS (
     SELECT word, (best // 4294967296)::INTEGER AS merged, (best % 4294967296)::INTEGER AS kept, gone,
            t.right_pos AS next_pos, t.right_id AS next_id
     FROM best JOIN t USING (word) WHERE t.pos = gone)
   SELECT round + 1, word, pos, CASE WHEN pos = kept THEN merged ELSE id END,
          CASE WHEN pos = kept THEN next_pos ELSE right_pos END,
          CASE WHEN pos = kept THEN next_id WHEN right_pos = kept THEN merged ELSE right_id END
   FROM t JOIN pair USING (word) WHERE pos <> gone)
),
last AS (SELECT word, max(round) AS round FROM t GROUP BY word)
SELECT word, string_agg(id::VARCHAR, ',' {order}) AS ids, string_agg(hex, '' {order}) AS hex
FROM (SELECT word, pos, id, hex FROM t JOIN last USING (word, round) JOIN vocabulary USING (id) ORDER BY word, pos)
GROUP BY word
"""

# Keyed by position, so that only the present tokens are held; a token that is merged away has no id.
# Of a run of overlapping occurrences (l = r) every second one counts. An occurrence is the last of
# its round if the token it makes forms a pair of lower rank with a neighbour: that pair is next.
_RECURSIVE_LONG = """
WITH RECURSIVE t(word, pos, id, right_pos, right_id) USING KEY (word, pos) AS (
  SELECT word, pos, id, right_pos, right_id FROM start
  UNION
  (WITH live AS (SELECT * FROM recurring.t WHERE id IS NOT NULL),
   pairs AS (SELECT word, pos, right_pos, rank FROM live JOIN merges ON merges.l = id AND merges.r = right_id),
   least AS (SELECT word, min(rank) AS rank FROM pairs GROUP BY word),
   found AS (
     SELECT word, pos, right_pos AS gone, rank::INTEGER AS merged,
            coalesce(lag(right_pos) OVER (PARTITION BY word ORDER BY pos) <> pos, true) AS apart
     FROM pairs JOIN least USING (word, rank)),
   runs AS (SELECT *, sum(apart::INTEGER) OVER (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM found),
   places AS (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY pos) AS place FROM runs),
   odd AS (SELECT word, pos, gone, merged FROM places WHERE place % 2 = 1),
   beside AS (
     SELECT odd.*, g.right_pos AS next_pos, g.right_id AS next_id,
            CASE WHEN p.pos IS NOT NULL THEN odd.merged ELSE b.id END AS before_id
     FROM odd JOIN live g ON g.word = odd.word AND g.pos = odd.gone
     LEFT JOIN live b ON b.word = odd.word AND b.right_pos = odd.pos
     LEFT JOIN odd p ON p.word = odd.word AND p.gone = b.pos),
   lower_pairs AS (
     SELECT word, min(pos) AS last FROM (
       SELECT word, pos FROM beside JOIN merges ON merges.l = before_id AND merges.r = merged WHERE rank < merged
       UNION ALL SELECT word, pos FROM beside JOIN merges ON merges.l = merged AND merges.r = next_id WHERE rank < merged)
     GROUP BY word),
   hits AS (SELECT beside.* FROM beside LEFT JOIN lower_pairs USING (word) WHERE pos <= coalesce(last, pos))
   SELECT h.word, h.pos, h.merged, h.next_pos, coalesce(k.merged, h.next_id)
   FROM hits h LEFT JOIN hits k ON k.word = h.word AND k.pos = h.next_pos
   UNION ALL SELECT word, gone, NULL, NULL, NULL FROM hits
   UNION ALL
   SELECT b.word, b.pos, b.id, b.right_pos, h.merged
   FROM live b JOIN hits h ON h.word = b.word AND h.pos = b.right_pos
   LEFT JOIN hits k ON k.word = b.word AND k.gone = b.pos WHERE k.pos IS NULL)
)
SELECT word, string_agg(id::VARCHAR, ',' {order}) AS ids, string_agg(hex, '' {order}) AS hex
FROM (SELECT word, pos, id, hex FROM t JOIN vocabulary USING (id) ORDER BY word, pos)
GROUP BY word
"""


class Codec:
    """Encodes words by the ranks of a vocabulary file; one per worker process and file."""

    def __init__(self, ranks_file: str, pattern: str) -> None:
        import regex

        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.ids: dict[str, str] = {}  # of a word: its ids, joined by commas
        self.raw: dict[str, bytes] = {}  # and the bytes they decode to
        self.older: tuple[dict, dict] = ({}, {})
        self.db = None
        splits = [
            (self.ranks[t[:i]], self.ranks[t[i:]], r)
            for t, r in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        l, r, m = (pa.array(x, pa.int32()) for x in zip(*splits, strict=True)) if splits else (pa.array([], pa.int32()),) * 3
        self.fixed = {
            "merges": pa.table({"l": l, "r": r, "rank": m.cast(pa.int64())}),
            "vocabulary": pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]}),
        }
        self.trie: tuple[np.ndarray, np.ndarray] | None = None
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def _open(self) -> None:
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "preserve_insertion_order": True})
        self.db.execute("SET temp_directory = ''")  # queries are made to fit
        for name, rows in self.fixed.items():
            self._table(name, rows)

    def rest(self) -> None:
        """Give memory back between tasks: the worker lives on, perhaps with other work. The dictionary stays."""
        if self.db is not None:
            self.db.close()
        self.db = None
        trim()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("arrow_rows", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM arrow_rows")
        self.db.unregister("arrow_rows")

    def learn(self, words: set[str]) -> None:
        """Adds the words to the dictionary: whole tokens at once, others by the recursive queries.

        A full generation becomes the older one and the older one goes; words in use move up.
        """
        if len(self.ids) > KEPT_WORDS:
            self.older, self.ids, self.raw = (self.ids, self.raw), {}, {}
        rows: list[bytes] = []
        names: list[str] = []
        old_ids, old_raw = self.older
        for w in words - self.ids.keys():
            if (known := old_ids.get(w)) is not None:
                self.ids[w], self.raw[w] = known, old_raw[w]
                continue
            b = w.encode("utf-8", "replace")
            if (i := self.ranks.get(b)) is not None:
                self.ids[w], self.raw[w] = str(i), b
            else:
                rows.append(b)
                names.append(w)
        pieces, count = self._pieces(rows)
        ids, raw = self._contract_all(pieces)
        i = 0
        for w, n in zip(names, count, strict=True):
            self.ids[w], self.raw[w] = (ids[i], raw[i]) if n == 1 else (",".join(ids[i : i + n]), b"".join(raw[i : i + n]))
            i += n

    def _pieces(self, rows: list[bytes]) -> tuple[list[bytes], list[int]]:
        """The words, long ones cut where no token reaches across, and the number of pieces of each.

        No merge can make a token that isn't in the text, so nothing is ever merged across a cut.
        """
        pieces: list[bytes] = []
        count = []
        for b in rows:
            cuts = self._cuts(b) if len(b) > CUT_BYTES else [0, len(b)]
            pieces += [b[i:j] for i, j in zip(cuts, cuts[1:])]
            count.append(len(cuts) - 1)
        return pieces, count

    def _cuts(self, b: bytes) -> list[int]:
        """Bounds of the stretches of b that no token's occurrence (of two bytes or more) connects."""
        if self.trie is None:
            nodes: dict[bytes, int] = {}
            for t in self.ranks:
                for n in range(1, len(t) + 1):
                    nodes.setdefault(t[:n], len(nodes) + 1)
            edges = sorted((nodes.get(p[:-1], 0) * 256 + p[-1], n, len(p) > 1 and p in self.ranks) for p, n in nodes.items())
            self.trie = tuple(np.array(x) for x in zip(*edges, strict=True))
        keys, children, ends = self.trie
        data = np.frombuffer(b, np.uint8)
        reach = np.zeros(len(b) + 1, np.int32)
        at, node, depth = np.arange(len(b)), np.zeros(len(b), np.int64), 0
        while len(at):
            key = node * 256 + data[at + depth]
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            there = keys[k] == key
            at, k, depth = at[there], k[there], depth + 1
            whole = at[ends[k]]
            np.add.at(reach, whole + 1, 1)  # the bounds inside the token
            np.add.at(reach, whole + depth, -1)
            node = children[k]
            inside = at + depth < len(b)
            at, node = at[inside], node[inside]
        return [0, *(np.nonzero(np.cumsum(reach)[1:-1] == 0)[0] + 1).tolist(), len(b)]

    def _contract_all(self, pieces: list[bytes]) -> tuple[list[str], list[bytes]]:
        """Ids, joined by commas, and decoded bytes of each piece."""
        ids, raw = [""] * len(pieces), [b""] * len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        if pieces and self.db is None:
            self._open()
        for query in (_RECURSIVE, _RECURSIVE_LONG):
            keyed = query is _RECURSIVE_LONG
            some = np.nonzero((size > LONG_PIECE) == keyed)[0]
            some = some[np.argsort(size[some], kind="stable")]  # those of one query end in about the same round
            rows = size[some] * (1 if keyed else (size[some] + 7) // 8)  # a merge leaves the others' rows once more
            for at in np.split(some, np.nonzero(np.diff(np.cumsum(rows) // QUERY_ROWS))[0] + 1):
                if len(at):
                    if keyed:
                        self.db.execute(f"SET memory_limit = '{max(MEMORY_MB, int(size[at].sum()) // 2000)}MB'")
                    self._contract(at.tolist(), [pieces[i] for i in at], ids, raw, query)
        return ids, raw

    def _contract(self, at: list[int], pieces: list[bytes], ids: list[str], raw: list[bytes], query: str) -> None:
        size = np.array([len(b) for b in pieces])
        ends = np.cumsum(size)
        word = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        pos = (np.arange(ends[-1]) - np.repeat(ends - size, size)).astype(np.int32)
        byte = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        last = np.zeros(len(byte), bool)
        last[ends - 1] = True
        right_id = pa.array(np.roll(byte, -1), mask=last)
        right_pos = pa.array(pos + 1, mask=last)
        self._table("start", pa.table({"word": word, "pos": pos, "id": byte, "right_pos": right_pos, "right_id": right_id}))
        found = self.db.execute(query.replace("{order}", "")).fetchall()
        if any(bytes.fromhex(h) != pieces[w] for w, _, h in found):  # one thread aggregates in the sorted order; if ever not, order each aggregate
            found = self.db.execute(query.replace("{order}", "ORDER BY pos")).fetchall()
        for w, i, h in found:
            ids[at[w]], raw[at[w]] = i, bytes.fromhex(h)

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text its ids joined by commas and the bytes they decode to."""
        words = [self.find(t) for t in texts]
        self.learn(set().union(*words))
        ids, raw = self.ids.__getitem__, self.raw.__getitem__
        return [(",".join(map(ids, ws)), b"".join(map(raw, ws))) for ws in words]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_file: str, pattern: str) -> Codec:
    key = (ranks_file, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def encode_decode(docs: DataFrame, ranks_file: str, pattern: str, ids: bool = True, decoded: bool = True, keep: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_tokens, [ids, decoded,] ids_sha256, decoded_sha256.

    Each match of pattern is a word and is encoded by the ranks of the vocabulary file, as
    tiktoken does: a word that is itself a token is that token. ids is the list of token ids,
    decoded the bytes that they stand for; either can be left out, their SHA-256 remain. keep names further columns of docs to carry along. A null text is an empty
    one, with no tokens; an empty table gives no rows; repeated rows give repeated rows. The
    tokens of a document never depend on other documents, so nothing is shuffled. Words of any
    length take the same way (scripts without spaces, a megabyte of one letter).
    """
    carried = [c for c in (keep or []) if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", *carried)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"doc_id {types['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * ids + ", decoded binary" * decoded + "".join(f", `{c}` {types[c]}" for c in carried)

    def batches(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
        """Pieces of a batch whose texts together stay under BATCH_CHARS."""
        texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
        start, chars = 0, 0
        for i, t in enumerate(texts):
            if i > start and chars + len(t) > BATCH_CHARS:
                yield start, texts[start:i]
                start, chars = i, 0
            chars += len(t)
        if texts:
            yield start, texts[start:]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_file, pattern)
        for batch in it:
            for start, texts in batches(batch):
                n, ids_hash, text_hash, all_ids, all_raw = [], [], [], [], []
                for listed, raw in c.encode(texts):
                    n.append(listed.count(",") + 1 if listed else 0)
                    ids_hash.append(hashlib.sha256(listed.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(raw).hexdigest())
                    if ids and listed:
                        all_ids.append(np.fromstring(listed, np.int32, sep=","))
                    if decoded:
                        all_raw.append(raw)
                part = batch.slice(start, len(texts))
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                if ids:
                    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*all_ids, np.zeros(0, np.int32)]))))
                if decoded:
                    cols.append(pa.array(all_raw, pa.binary()))
                cols += [part.column(2 + k) for k in range(len(carried))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids, *["decoded"] * decoded, *carried])
        c.rest()

    return rows.mapInArrow(run, schema)
