"""Vectorised byte and word helpers used inside Arrow tasks.

All helpers work on a chunk: the UTF-8 bytes of some whole documents laid end
to end. Chunks are cut between documents, so memory follows the longest
document and the chunk size, never the partition size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
CHUNK_DOCS = 2048
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_CODES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of the two word definitions: between ASCII white space, and
#: runs of digits, letters and non-ASCII characters.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[32, 9, 10, 11, 12, 13]] = False
NAME_WORDS = np.zeros(256, dtype=bool)
NAME_WORDS[48:58] = NAME_WORDS[65:91] = NAME_WORDS[97:123] = NAME_WORDS[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if len(have) <= 4 * CHUNK:
            _powers[int(base)] = have
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; ``span_hash`` reads any span from them."""
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[buf] * powers(BASE, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end), the same wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(BASE_INV, len(prefix))[start] + (end - start).astype(np.uint64))


@dataclass
class Chunk:
    buf: np.ndarray       # uint8
    offsets: np.ndarray   # document i is buf[offsets[i]:offsets[i + 1]]
    first: int            # index of the first document in its Arrow batch

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.offsets)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset:]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]] if n else buf[:0], off - off[0]


def chunks(column: pa.Array, size: int = CHUNK, docs: int = CHUNK_DOCS) -> Iterator[Chunk]:
    """Whole documents in order, about ``size`` bytes (and at most ``docs`` documents) at a time."""
    buf, off = text_buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        j = min(j, n, i + docs)
        yield Chunk(buf[off[i]:off[j]], off[i:j + 1] - off[i], i)
        i = j


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray     # words of document i are first[i]:first[i + 1]

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(c: Chunk, table: np.ndarray, lower: bool = True) -> Words:
    """Words of a chunk with a 64-bit hash each; no word crosses documents."""
    buf = LOWER[c.buf] if lower else c.buf
    inside = table[buf]
    n = len(buf)
    edge = np.zeros(n + 1, dtype=bool)
    edge[c.offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = span_hash(prefix_hash(buf), start, end) if len(start) else np.zeros(0, np.uint64)
    return Words(start, end, h, np.searchsorted(start, c.offsets))


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
