"""Benchmark decontamination: edit-tolerant search for benchmark items in texts.

* **Windows.** An item that may take k edits is cut into k + 1 pieces of bytes,
  so at least one stands unchanged in every hit. Every place of a text where a
  piece stands gives one item-sized window, aligned so that the piece falls
  where the item has it. Pieces know no words, so unspaced scripts are like others.
* **CGK embedding.** A window and its item walk the same random walks, from the
  piece to both ends: at step j a copy of the current byte is written and the
  walk moves on by the random bit of (j, byte). Strings at edit distance d come out at Hamming distance
  O(d^2) with constant probability; ``WALKS`` independent walks are taken.
* **Bit-sampling LSH.** From each walk ``POOL`` positions are read and ``TABLES``
  samples of ``BITS`` of them taken; a window whose sample equals its item's in any table is a candidate,
  and no other window is.
* **Verification** is exact: the smallest edit distance between the item and
  any piece of the text around the window, by bit-parallel dynamic programming.

A hit is an item with edit distance at most ``share`` of its length. Strings
are compared as the UTF-8 bytes of the text in lower case; offsets count them. Rows are
independent of each other, so no shuffle is needed; the items are sent to the
tasks in blocks of bounded size, one pass over the texts for each block, and the
driver holds one block at a time.

Defined results: null and empty texts, and items without a word, have no hit.
Repeated items are found each under its own id, repeated rows each in its own
row. Items with a null id keep the null id. Windows at the edges of a text are
cut there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import BASE_INV, NAME_WORDS, Chunk, chunks, mix, powers, prefix_hash
from .stage import stage, table

WALKS, POOL, TABLES, BITS = 2, 64, 96, 6
SHARE, SEED = 0.1, 5
BLOCK_BYTES = 1 << 19                    # item bytes of a pass over the texts; their keys take some 200 times as much
PAD = 256
PERIOD = 1024                            # random bits of a walk repeat after so many steps
PART_ROWS, PART_BYTES = 1024, 1 << 20    # windows that walk together
SIEVE = 20                               # bits of a piece's hash in the sieve


@dataclass(frozen=True)
class Items:
    ids: list
    text: list[bytes]
    hash: np.ndarray      # sorted hashes of the pieces
    raw: np.ndarray       # the same before they are mixed
    item: np.ndarray      # item of each piece
    at: np.ndarray        # byte offset of the piece in its item
    size: np.ndarray      # its bytes
    buf: np.ndarray       # the texts end to end
    first: np.ndarray     # where each begins, and the end

    held: np.ndarray      # LSH keys of each item around each of its pieces
    known: np.ndarray     # whether they are computed

    def keys(self, piece: np.ndarray) -> np.ndarray:
        new = np.unique(piece[~self.known[piece]])
        first, at = self.first[self.item[new]], self.at[new]
        last = self.first[self.item[new] + 1]
        past = first + at + self.size[new]
        self.held[new] = embed(self.buf, first, first + at, past, last, at, last - past).T
        self.known[new] = True
        return self.held[piece].T


def folded(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def prepare(ids: list, texts: list[str | None], share: float = SHARE) -> Items:
    column = folded(pa.array([t or "" for t in texts], pa.string()))
    lower = [t.encode() for t in column.to_pylist()]
    slack = np.array([int(share * len(t)) for t in lower], np.int64)
    worded = [bool(NAME_WORDS[np.frombuffer(t, np.uint8)].any()) for t in lower]
    n = np.where(worded, slack + 1, 0).astype(np.int64)
    item = np.repeat(np.arange(len(lower)), n)
    size = np.array([len(t) for t in lower], np.int64)[item] // n[item]
    at = (np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)) * size
    base = np.cumsum([0, *map(len, lower)])[item] + at
    prefix = prefix_hash(np.frombuffer(b"".join(lower), np.uint8))
    raw = (prefix[base + size] - prefix[base]) * powers(BASE_INV, len(prefix))[base]
    h = mix(raw + size.astype(np.uint64))
    order = np.argsort(h, kind="stable")
    return Items(ids, lower, h[order], raw[order], item[order], at[order], size[order],
                 np.frombuffer(b"".join(lower), np.uint8), np.cumsum([0, *map(len, lower)]),
                 np.zeros((len(h), WALKS * TABLES), np.uint64), np.zeros(len(h), bool))


def windows(c: Chunk, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, aligned start in the chunk; may lie before the document), by document, item and start."""
    prefix, rows = prefix_hash(c.buf), []
    for size in np.unique(items.size):
        sieve = np.zeros(1 << SIEVE, bool)
        sieve[items.raw[items.size == size] >> np.uint64(64 - SIEVE)] = True
        n = max(len(c.buf) - size + 1, 0)
        raw = (prefix[size:size + n] - prefix[:n]) * powers(BASE_INV, len(prefix))[:n]
        start = np.flatnonzero(sieve[raw >> np.uint64(64 - SIEVE)])
        h = mix(raw[start] + np.uint64(size))
        doc = np.searchsorted(c.offsets, start, "right") - 1
        lo, hi = np.searchsorted(items.hash, h, "left"), np.searchsorted(items.hash, h, "right")
        n = np.where(start + size <= c.offsets[doc + 1], hi - lo, 0)
        hit = np.repeat(np.arange(len(n)), n)
        entry = lo[hit] + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
        rows.append(np.stack([doc[hit], entry, start[hit] - items.at[entry]]))
    doc, piece, start = np.concatenate([np.zeros((3, 0), np.int64), *rows], axis=1)
    order = np.lexsort((start, items.item[piece], doc))
    return doc[order], piece[order], start[order]


@lru_cache
def _strides(seed: int, walk: int) -> np.ndarray:
    """Steps that a walk stays on a byte, by (step modulo PERIOD, byte): until the first random bit that is 1."""
    moves = np.random.default_rng([seed, walk, 1]).integers(0, 2, (PERIOD, PAD + 1), dtype=np.int8)
    moves[-1] = 1
    out = np.empty(moves.shape, np.int64)
    out[-1] = 1
    for j in range(PERIOD - 2, -1, -1):
        out[j] = np.where(moves[j] == 1, 1, out[j + 1] + 1)
    return out.ravel()


def embed(buf: np.ndarray, lo: np.ndarray, at: np.ndarray, past: np.ndarray, hi: np.ndarray, before: np.ndarray,
          after: np.ndarray) -> np.ndarray:
    """LSH keys of the strings buf[lo:hi] around the pieces buf[at:past]: (WALKS * TABLES, n).

    One walk leads from the piece to the end and one back to the beginning, so edits shift what lies behind
    them only. A walk goes on in all strings at once and notes the step at which it reaches each byte; the byte
    at a sampled step is the last one reached by then. Steps are drawn from ``before`` and ``after``, the lengths
    of the item on both sides of the piece. A key holds the sampled bytes themselves.
    """
    n, line = len(lo), np.arange(2 * len(lo))
    out = np.zeros((WALKS * TABLES, n), np.uint64)
    longest = int(max(before.max(initial=0), after.max(initial=0)))
    if not n or not longest:
        return out
    i = np.arange(longest + 1)[:, None]
    there = np.concatenate([past + i, at - 1 - i], axis=1)
    inside = np.concatenate([past + i < hi, at - 1 - i >= lo], axis=1)
    mat = np.where(inside, buf[np.where(inside, there, 0)], PAD).astype(np.int16)
    for walk in range(WALKS):
        stay = _strides(SEED, walk)
        reached = np.zeros((2 * longest + 1, 2 * n), np.int16 if longest < 1 << 14 else np.int32)
        flat, step, entry = reached.ravel(), np.zeros(2 * n, np.int64), np.empty(2 * n, np.int64)
        for i in range(longest):
            np.bitwise_and(step, PERIOD - 1, out=entry)
            entry *= PAD + 1
            entry += mat[i]
            step += stay[entry]
            np.minimum(step, 2 * longest, out=step)
            np.multiply(step, 2 * n, out=entry)
            entry += line
            flat[entry] = 1
        for j in range(1, 2 * longest):        # bytes reached by each step
            reached[j] += reached[j - 1]
        draw = np.random.default_rng([SEED, walk])
        pick = (draw.random((POOL, 1)) * (2 * (before + after))).astype(np.int64)    # later steps would mostly copy the padding
        back = pick >= 2 * after
        column = line[:n] + n * back
        got = mat[reached[pick - back * (2 * after), column], column].astype(np.uint64)
        sample = draw.integers(0, POOL, (TABLES, BITS))
        out[walk * TABLES:(walk + 1) * TABLES] = sum(got[sample[:, b]] << np.uint64(9 * b) for b in range(BITS))
    return out


def edit_distance(item: bytes, region: bytes, most: int | None = None) -> tuple[int, int]:
    """Smallest edit distance between ``item`` and any piece of ``region``, and where the first such piece ends.

    Columns of the dynamic program are kept as bits of whole numbers, one bit a byte of the item. The
    distance falls by one a byte at most: the rest of the region is left out once it can't come to ``most``."""
    exact = region.find(item)
    if exact >= 0:
        return 0, exact + len(item)
    full, top, places = (1 << len(item)) - 1, 1 << len(item) >> 1, dict.fromkeys(region, 0)
    for i, byte in enumerate(item):
        if byte in places:
            places[byte] |= 1 << i
    more, less, d = full, 0, len(item)         # where the column grows and falls from one row to the next
    best, limit = (d, 0), len(item) if most is None else most
    for j, byte in enumerate(region):
        same = places[byte]
        flat = same | less
        diagonal = (((same & more) + more) ^ more) | same
        up, down = less | (full & ~(diagonal | more)), more & diagonal
        if up & top:
            d += 1
            if d - len(region) + j >= limit:
                break
        elif down & top:
            d -= 1
        up, down = up << 1 & full, down << 1 & full
        more, less = down | (full & ~(flat | up)), up & flat
        if d < best[0]:
            best = d, j + 1
    return best


def search(column: pa.Array, items: Items, share: float = SHARE):
    """(document, item, start, end, distance) of the hits in a column of texts."""
    out = []
    length = np.array([len(t) for t in items.text], np.int64)
    for c in chunks(folded(column)):
        doc, piece, start = windows(c, items)
        item = items.item[piece]
        order = np.lexsort((piece, length[item]))          # alike sizes walk together, and a piece's windows
        like, part = np.zeros(len(doc), bool), 0
        lo, hi = np.maximum(start, c.offsets[doc]), np.minimum(start + length[item], c.offsets[doc + 1])
        at, size = items.at[piece], items.size[piece]
        while part < len(doc):
            longest = int(length[item[order[min(part + PART_ROWS, len(doc)) - 1]]])
            k = order[part:part + min(PART_ROWS, max(1, PART_BYTES // longest))]
            keys = embed(c.buf, lo[k], start[k] + at[k], start[k] + at[k] + size[k], hi[k], at[k], length[item[k]] - at[k] - size[k])
            like[k] = (keys == items.keys(piece[k])).any(axis=0)
            part += len(k)
        doc, item, start = doc[like], item[like], start[like]
        k = 0
        while k < len(doc):                  # candidates of an item that begin within its slack are one region
            t, slack = items.text[item[k]], int(share * length[item[k]])
            end = k + 1
            while end < len(doc) and doc[end] == doc[k] and item[end] == item[k] and start[end] - start[k] <= slack:
                end += 1
            begin = int(c.offsets[doc[k]])
            a, b = max(int(start[k]) - slack, begin), min(int(start[end - 1]) + len(t) + slack, int(c.offsets[doc[k] + 1]))
            d, e = edit_distance(t, c.buf[a:b].tobytes(), slack)
            if d <= slack:
                stop = a + e - begin
                out.append((c.first + int(doc[k]), int(item[k]), max(stop - len(t), 0), stop, d))
            k = end
    return merged(out, items)


def merged(found: list[tuple], items: Items) -> list[tuple]:
    """One hit for each place: of hits of an item that overlap by half, the closest stays."""
    out: list[tuple] = []
    for h in sorted(found, key=lambda h: (h[0], h[1], h[3], h[4])):
        if out and out[-1][:2] == h[:2] and h[2] < out[-1][3] - len(items.text[h[1]]) // 2:
            if (h[4], h[2]) < (out[-1][4], out[-1][2]):
                out[-1] = h
        else:
            out.append(h)
    return out


def blocks(benchmark: DataFrame) -> Iterator[tuple[pa.Array, list]]:
    """The items, ids and texts, in blocks of about BLOCK_BYTES by hash; the driver holds one block at a time."""
    items = benchmark.select("item_id", "text")
    n, held = items.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()
    count = -(-(held or 0) // BLOCK_BYTES)
    for k in range(count):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").toArrow()
        yield got.column("item_id").combine_chunks(), got.column("text").to_pylist()


def hits(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """One row for each document row and item found in it.

    doc_id, item_id, n_places, distance (smallest), first_byte, end_byte (of the closest place).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, n_places long, distance long, first_byte long, end_byte long"
    base, out = docs.select("doc_id", "text"), None
    for ids, texts in blocks(benchmark):
        part = base.mapInArrow(_hit_rows(ids, texts, share), schema)
        # from the second block on, each pass is written before the next block is read
        out = part if out is None else stage(out.union(part), "hits")
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _hit_rows(ids, texts, share):
    def run(batches):
        items = prepare(ids.to_pylist(), texts, share)
        for b in batches:
            best: dict = {}
            for doc, item, start, end, d in search(b.column("text"), items, share):
                was = best.get((doc, item), (0, d, start, end))
                best[doc, item] = (was[0] + 1, *min(was[1:], (d, start, end)))
            rows = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())),
                 ids.take(pa.array([r[1] for r in rows], pa.int64())),
                 *(pa.array([best[r][k] for r in rows], pa.int64()) for k in range(4))],
                ["doc_id", "item_id", "n_places", "distance", "first_byte", "end_byte"])
    return run


def op10_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = docs.select(*cols)
    schema = docs.schema
    first = True
    for ids, texts in blocks(table(spark, sf_dir, "benchmark")):
        docs = (docs if first else stage(docs, "clean")).mapInArrow(_clean_rows(ids.to_pylist(), texts, SHARE), schema)
        first = False
    return docs


def _clean_rows(ids, texts, share):
    def run(batches):
        items = prepare(ids, texts, share)
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            clean[[x[0] for x in search(b.column("text"), items, share)]] = False
            yield b.filter(pa.array(clean))
    return run
