"""Near-duplicates by SimHash, found with a byte-position inverted index.

A text's fingerprint is the 64-bit majority of the XXH64 hashes (seed 42) of its
shingles of three lower-cased words, repeats included. Two texts are linked if
their fingerprints differ in at most ``DISTANCE`` = 2 bits.

The index posts each distinct fingerprint under the bytes at its eight byte
positions. Two differing bits spoil at most two positions, so linked fingerprints
share at least ``LEAST`` = 6 positional bytes, and a pair with fewer can't be
linked. Postings of single positions would hold a 256th of all fingerprints
each, so a list is opened only by four positional bytes together: whichever two
of the eight positions are spoilt, one of the six unions of two position pairs
(0 1, 2 3, 4 5, 6 7) is whole. Inside a list the shared positional bytes of each
pair are tallied, pairs that reach the least number of matches are retained, and
their bits are compared.

A list with more than ``LIST`` fingerprints is split by two more of its four
other positional bytes, whichever agree: a linked pair still shares two of the
four. Such a sublist agrees in six positions, so it has at most 65,536 distinct
fingerprints, and each looks up the 136 values at distance one and two of its two
free bytes. No list is capped or sampled.

A list passes on one link for each linked member, to the smallest fingerprint it
reaches inside the list; the components are the same as those of all links.

Defined results: null and empty texts have no words and fingerprint zero, which is
linked like any other; a text of one or two words is one shingle. Equal
fingerprints, repeated ids and repeated rows share a component; it is named by its
smallest doc_id, null if it has none. An empty table gives no rows. Only doc_id
and text are read, whatever the other columns are called.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, SPACE_WORDS, chunks, words
from .components import components
from .stage import drop, stage, table

K, SEED, DISTANCE = 3, 42, 2
POSITIONS, LEAST, LIST = 8, 6, 64
CHUNK = 1 << 20

#: Unions of two of the four position pairs, and the position pairs outside each union.
_HALVES = [(*(2 * i, 2 * i + 1), *(2 * j, 2 * j + 1)) for i, j in combinations(range(4), 2)]
#: Index lists by number: the positions that agree; six of four positions, then, for each, six of six.
SHORT = [tuple(h) for h in _HALVES]
LONG = [tuple(sorted((*h, *more))) for h in _HALVES for more in combinations([p for p in range(POSITIONS) if p not in h], 2)]
#: All changes of one or two of 16 bits.
FLIPS = np.array([1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)], np.uint64)


# -- fingerprints -----------------------------------------------------------------------------------------------

def _fingerprint(batches):
    for b in batches:
        for c in chunks(b.column("text"), CHUNK):
            w = words(c, SPACE_WORDS)
            low = LOWER[c.buf]
            size = w.end - w.start
            # the words of the chunk joined by one space each; a shingle is a span of this line
            begin = np.cumsum(size + 1) - size - 1
            line = np.full(int((size + 1).sum()), 32, np.uint8)
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            line[np.repeat(begin, size) + at] = low[np.repeat(w.start, size) + at]
            doc, n = w.doc, w.count
            place = np.arange(len(doc)) - w.first[doc]
            opens = np.flatnonzero((place + K <= n[doc]) | (place == 0))
            closes = np.minimum(opens + K, w.first[doc[opens] + 1]) - 1
            raw, left, right = line.tobytes(), begin[opens].tolist(), (begin[closes] + size[closes]).tolist()
            digest = xxhash.xxh64_intdigest
            h = np.array([digest(raw[i:j], SEED) for i, j in zip(left, right)], np.uint64)
            print_ = np.zeros(len(c), np.uint64)
            if len(h):
                bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
                owner = doc[opens]
                first = np.flatnonzero(np.concatenate([[True], np.diff(owner) > 0]))
                votes = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
                total = np.diff(np.concatenate([first, [len(h)]]))
                print_[owner[first]] = np.packbits(2 * votes > total[:, None], axis=1).view(np.uint64)[:, 0]
            yield pa.RecordBatch.from_arrays([b.column("doc_id")[c.first:c.first + len(c)], pa.array(print_.view(np.int64))],
                                             ["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print): the fingerprint's 64 bits as a signed long, one row a document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprint, f"doc_id {kind}, print long")


# -- the index --------------------------------------------------------------------------------------------------

def positional(prints: np.ndarray, positions: tuple[int, ...]) -> np.ndarray:
    """The bytes of the fingerprints at some positions, side by side in one number."""
    out = np.zeros(len(prints), np.uint64)
    for p in positions:
        out = out << np.uint64(8) | prints >> np.uint64(8 * p) & np.uint64(255)
    return out


def _post(lists):
    """Post each fingerprint in index lists, by number; ``lists`` has (number, positions) by the list it comes from."""
    def run(batches):
        for b in batches:
            x = b.column("print").to_numpy().view(np.uint64)
            parent = b.column("list").to_numpy()
            number, key, out = [], [], []
            for p in np.unique(parent):
                mine = x[parent == p]
                for k, positions in lists[int(p)]:
                    number.append(np.full(len(mine), k, np.int32)), key.append(positional(mine, positions)), out.append(mine)
            cat = lambda parts, t: np.concatenate([np.zeros(0, t), *parts])
            yield pa.RecordBatch.from_arrays([pa.array(cat(number, np.int32)), pa.array(cat(key, np.uint64).view(np.int64)),
                                              pa.array(cat(out, np.uint64).view(np.int64))], ["list", "key", "print"])
    return run


def shared_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tally of the positional bytes that two fingerprints share."""
    return ((x ^ y).view(np.uint8).reshape(-1, POSITIONS) == 0).sum(axis=1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member that each of n members reaches through the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _tally(x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside short lists: tally, keep pairs with enough matches, compare their bits."""
    a, b = [], []
    for far in range(1, LIST):
        i = np.flatnonzero(group[far:] == group[:-far]) if far < len(x) else group[:0]
        if not len(i):
            break
        i = i[shared_bytes(x[i], x[i + far]) >= LEAST]
        i = i[np.bitwise_count(x[i] ^ x[i + far]) <= DISTANCE]
        a.append(i), b.append(i + far)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _lookup(x: np.ndarray, group: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside sublists: the two free bytes with one or two bits changed, looked up among the list's own."""
    key = group.astype(np.uint64) << np.uint64(16) | free
    order = np.argsort(key)
    key = key[order]
    a, b = [], []
    for flip in FLIPS:
        at = np.minimum(np.searchsorted(key, key ^ flip), len(key) - 1)
        i = np.flatnonzero((key[at] == key ^ flip) & (np.arange(len(key)) < at))
        a.append(order[i]), b.append(order[at[i]])
    return np.concatenate(a), np.concatenate(b)


def _match(long: bool):
    """Rows sorted by list and key -> (print, root, list): a link to root, or list >= 0 for a member of a list to be split."""
    def lists(number, key, x):
        change = np.concatenate([[True], (np.diff(number) != 0) | (key[1:] != key[:-1])])
        group = np.cumsum(change) - 1
        size = np.bincount(group)[group]
        split = np.zeros(len(x), bool) if long else size > LIST
        whole = np.flatnonzero((size > 1) & ~split)
        if len(whole):
            if long:
                free = np.zeros(len(whole), np.uint64)
                for k in np.unique(number[whole]):
                    mine = number[whole] == k
                    free[mine] = positional(x[whole[mine]], tuple(p for p in range(POSITIONS) if p not in LONG[k]))
                a, b = _lookup(x[whole], group[whole], free)
            else:
                a, b = _tally(x[whole], group[whole])
            root = _roots(len(whole), a, b)
            linked = np.flatnonzero(root != np.arange(len(whole)))
            yield x[whole[linked]], x[whole[root[linked]]], np.full(len(linked), -1, np.int32)
        if split.any():
            yield x[split], x[split], number[split].astype(np.int32)

    def run(batches):
        held = None
        for b in batches:
            now = [b.column("list").to_numpy(), b.column("key").to_numpy(), b.column("print").to_numpy().view(np.uint64)]
            now = now if held is None else [np.concatenate(z) for z in zip(held, now)]
            number, key, x = now
            if not len(x):
                continue
            # the last list may go on in the next batch
            cut = int(np.flatnonzero((number != number[-1]) | (key != key[-1]))[-1]) + 1 if (number[0], key[0]) != (number[-1], key[-1]) else 0
            held = [z[cut:] for z in now]
            if cut:
                yield from out(number[:cut], key[:cut], x[:cut])
        if held is not None and len(held[0]):
            yield from out(*held)

    def out(number, key, x):
        for p, root, k in lists(number, key, x):
            yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(root.view(np.int64)), pa.array(k)], ["print", "root", "list"])
    return run


def _met(prints: DataFrame, lists: dict, long: bool) -> DataFrame:
    entry = prints.mapInArrow(_post(lists), "list int, key long, print long")
    return (entry.repartition("list", "key").sortWithinPartitions("list", "key")
            .mapInArrow(_match(long), "print long, root long, list int"))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints (distinct ``print``) at a distance of two bits or fewer."""
    first = stage(_met(prints.select("print", F.lit(0).alias("list")), {0: list(enumerate(SHORT))}, False), "lists")
    # a list to be split shares its four positions; list k has the sublists 6 k to 6 k + 5
    below = {k: [(6 * k + i, LONG[6 * k + i]) for i in range(6)] for k in range(len(SHORT))}
    second = stage(_met(first.where("list >= 0").select("print", "list").distinct(), below, True), "sublists")
    out = stage(first.where("list < 0").union(second).select(F.col("print").alias("a"), F.col("root").alias("b")).distinct(), "links")
    drop(first, second)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row a document."""
    rows = stage(fingerprints(docs), "prints")
    per_print = stage(rows.groupBy("print").agg(F.min("doc_id").alias("low")), "distinct")
    link = links(per_print)
    comp = components(link)
    known = stage(per_print.join(comp, F.col("print") == F.col("node"), "left")
                  .select("print", "low", F.coalesce("comp", "print").alias("comp")), "members")
    name = known.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = stage(known.join(name, "comp").select("print", "component_id"), "named")
    drop(per_print, link, comp, known)
    return rows.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
