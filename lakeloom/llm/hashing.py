"""Vectorised hashing of words and windows over the bytes of an Arrow text column."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
#: Bytes hashed at once; a longer text is taken alone.
CHUNK = 1_000_000


def trim() -> None:
    """Give memory that a finished task no longer uses back to the system; workers live on beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *[a.tobytes() for a in arrays]]))


def unsqueeze(blob: bytes, *types: type) -> list[np.ndarray]:
    """The arrays of squeeze, by their types."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(types), 8)
    out, at = [], 8 * (len(types) + 1)
    for t, n in zip(types, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw[at : at + n], t))
        at += n
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
# For windows of a fixed, short length, whose hashes follow from prefix sums.
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, base: int, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        have = np.concatenate([[np.uint64(1)], np.full(max(n, CHUNK), np.uint64(base))])
        _powers[which] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


#: A number for each byte at each of the first PLACES places of a word, as if drawn at random.
PLACES = 64
_AT = mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * np.uint64(_BASE))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8), o


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about size bytes: first, end, their bytes, their offsets from 0."""
    data, o = utf8(column)
    first, n = 0, len(column)
    while first < n:
        end = max(first + 1, int(np.searchsorted(o, o[first] + size, "right")) - 1)
        end = min(end, n)
        yield first, end, data[o[first] : o[end]], o[first : end + 1] - o[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hash, text number) of the words of a chunk, A-Z lower-cased.

    A word's hash is the sum of unrelated numbers, one for each byte at its place, and not of powers
    of one base, so that no regular pattern of letters gives two words the same.
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z
    solid = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1]
    after = np.concatenate([solid[1:], [False]]) & ~edge[1:]
    starts, ends = np.nonzero(solid & ~before)[0], np.nonzero(solid & ~after)[0] + 1
    sizes = ends - starts
    place = np.nonzero(solid)[0] - np.repeat(starts, sizes)
    value = _AT[(place % PLACES) * 256 + _LOWER[data[solid]]]
    if len(far := np.nonzero(place >= PLACES)[0]):
        value[far] = mix(value[far] + (place[far] // PLACES).astype(np.uint64) * _M1)
    first = np.cumsum(sizes) - sizes
    h = np.add.reduceat(value, first, dtype=np.uint64) if len(first) else np.zeros(0, np.uint64)
    h = mix(h + sizes.astype(np.uint64) * _M1)
    return starts, ends, h, np.searchsorted(offsets, starts, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each text; n_texts + 1 offsets into them).

    A shingle is n consecutive words; a text with fewer has one, the whole sequence.
    """
    _, _, h, text = words(data, offsets)
    count = np.bincount(text, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    if len(h) >= n:
        places = mix(np.arange(1001, 1001 + n, dtype=np.uint64)) | np.uint64(1)  # unrelated, so that no two orders of words add up alike
        s = sum((h[k : len(h) - n + 1 + k] * places[k] for k in range(n)), np.zeros(len(h) - n + 1, np.uint64))
        s, same = mix(s), text[: len(h) - n + 1] == text[n - 1 :]
        s, owner = s[same], text[: len(h) - n + 1][same]
    else:
        s, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    per = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(count)))])
    out = []
    for i, c in enumerate(count):
        if c >= n:
            x = np.sort(s[per[i] : per[i + 1]])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif c:
            x = np.uint64(c)
            for w in h[first[i] : first[i + 1]]:
                x = mix(np.atleast_1d(x * _M2 + w))[0]
            out.append(np.atleast_1d(x))
        else:
            out.append(np.zeros(0, np.uint64))
    sizes = np.array([len(x) for x in out], np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


np.seterr(over="ignore")
