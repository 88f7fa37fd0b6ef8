"""Periodic runs of words, found from Lyndon roots by the first phase of a suffix sorter.

A run is a stretch with smallest period q that no neighbouring word extends; runs
with at least ``COPIES`` = 4 periods and ``LEAST`` = 6 words are reported.

The grouping phase of the linear suffix sorter by Baier puts suffixes with equal
longest Lyndon prefix into one group: groups begin with the symbols; they are
taken in descending order; for each member the nearest position to the left that
is in a lower group takes the member's prefix onto its own, and those with equal
prefixes form a new group just above their old one (more prefixes taken on: a
higher group). When a group is taken its prefix is final, so its length is the
Lyndon array at its members; no suffix array is needed. Positions of taken groups
are passed over by a disjoint-set forest. It is done under the order of the
symbols and under its reverse: a run's Lyndon roots are longest Lyndon prefixes
under one of the two.

Members of a group at the group's own distance are equal Lyndon roots side by side.
A run with four periods holds three of them, so only such chains are extended, by
the longest common extensions to the left and right; these are shorter than the
root, so they are compared symbol by symbol, not by hashes.

Before that, stretches that can't touch a reported run are cut off. A run of four
periods and six words repeats each of its windows of three words inside the same
text, so words outside all repeated windows are in no run, and a run never
crosses them. Most prose ends here.

Defined results: null and empty texts and texts of white space have no words and no
runs; their collapsed text is empty. Repeated rows are texts of their own; ids are
carried along and may be null (no repetition is planted then). An empty table gives
no rows. Only doc_id and text are read, whatever the other columns are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import table, word_array

COPIES, LEAST = 4, 6
OUT = 1 << 22                            # bytes of collapsed text in a batch


def lyndon_groups(x: list[int]):
    """Groups of the positions of x by longest Lyndon prefix, largest first: (its length, ascending positions).

    Symbols are 0 .. max(x); the end counts as smaller than any symbol.
    """
    n = len(x)
    symbols = max(x) + 1 if n else 0
    members = [[] for _ in range(symbols)]
    for i, s in enumerate(x):
        members[s].append(i)
    group, length = list(x), [1] * symbols
    below, above = list(range(-1, symbols - 1)), list(range(1, symbols + 1))
    left = list(range(n + 1))            # position i is node i + 1; node 0 stands before the text
    g = symbols - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        size = length[g]
        for i in own:
            left[i + 1] = i
        taken: dict[int, int] = {}
        for i in own:
            node = i
            while left[node] != node:
                left[node] = node = left[left[node]]
            left[i + 1] = node
            if node:
                taken[node - 1] = taken.get(node - 1, 0) + 1
        if own:
            yield size, own
        new: dict[tuple[int, int], list[int]] = {}
        for j, times in taken.items():
            new.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(new, reverse=True):
            c, up = len(members), above[old]
            mine = sorted(new[times, old])
            members.append(mine)
            length.append(length[old] + times * size)
            below.append(old), above.append(up)
            above[old] = c
            below[up] = c
            for j in mine:
                group[j] = c
        g = below[g]


def lyndon_array(x: list[int]) -> list[int]:
    """Length of the longest Lyndon prefix of every suffix."""
    out = [0] * len(x)
    for size, own in lyndon_groups(x):
        for i in own:
            out[i] = size
    return out


def _extend(x: np.ndarray, a: int, b: int, most: int, way: int) -> int:
    """Common extension of the places a and b, to the right (way 1) or left (way -1), at most ``most``."""
    if way > 0:
        most = min(most, len(x) - b)
        differ = np.flatnonzero(x[a:a + most] != x[b:b + most])
    else:
        most = min(most, a + 1)
        differ = np.flatnonzero(x[a - most + 1:a + 1][::-1] != x[b - most + 1:b + 1][::-1])
    return int(differ[0]) if len(differ) else most


def runs_of(x: np.ndarray, copies: int = COPIES, least: int = LEAST) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of at least max(least, copies * period), copies >= 4."""
    found = set()
    _, code = np.unique(x, return_inverse=True)
    top = int(code.max()) if len(code) else 0
    for order in (code, top - code):
        for size, own in lyndon_groups(order.tolist()):
            if len(own) < copies - 1 or size * copies > len(x):
                continue
            at = np.array(own)
            # chains of members at the distance of the root's length
            place = np.minimum(np.searchsorted(at, at + size), len(at) - 1)
            goes_on = at[place] == at + size
            before = np.minimum(np.searchsorted(at, at - size), len(at) - 1)
            for first in at[goes_on & (at[before] != at - size)].tolist():
                last = first + size
                while (k := np.searchsorted(at, last + size)) < len(at) and at[k] == last + size:
                    last += size
                if (last - first) // size + 1 < copies - 1:
                    continue
                back = _extend(x, first - 1, first + size - 1, size, -1)
                ahead = _extend(x, last, last + size, size, 1)
                start, length = first - back, back + last - first + size + ahead
                if length >= max(least, copies * size):
                    found.add((start, length, size))
    return found


def repeated_stretches(code: np.ndarray, window: int = 3, least: int = LEAST) -> list[tuple[int, int]]:
    """[start, end) of the stretches covered by windows that occur twice or more; shorter ones than ``least`` left out."""
    n = len(code) - window + 1
    if n < 2:
        return []
    key = code[:n].astype(np.uint64)
    for j in range(1, window):           # equal windows have equal keys; unequal ones may, which only covers more
        key = key * np.uint64(0x9E3779B97F4A7C15) + code[j:n + j].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n + window, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    cover = again[:-1].copy()
    for j in range(1, window):
        cover[j:] |= again[:-1 - j]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
    return [(s, e) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()) if e - s >= least]


def text_runs(code: np.ndarray) -> list[tuple[int, int, int]]:
    """Reported runs of a whole text, by start and period."""
    found = [(start + s, length, period) for start, end in repeated_stretches(code)
             for s, length, period in runs_of(code[start:end])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _find(batches):
    def out(rows):
        ids, n, found, kept = zip(*rows)
        size = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = [r for f in found for r in f]
        part = lambda k: pa.array([r[k] for r in flat], pa.int64())
        run = pa.StructArray.from_arrays([part(0), part(1), part(2)], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(size), run),
                                           pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    for b in batches:
        rows, held = [], 0
        for i in range(b.num_rows):
            raw = (b.column("text")[i].as_py() or "").encode()
            words = raw.split()          # bytes split at ASCII white space only
            known: dict[bytes, int] = {}
            code = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
            found = text_runs(code) if len(known) < len(words) else []
            if found:
                gone = np.zeros(len(words) + 1, np.int64)
                for start, length, period in found:
                    gone[start + period] += 1
                    gone[start + length] -= 1
                words = [words[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
            rows.append((b.column("doc_id").slice(i, 1), len(code), found, b" ".join(words)))
            held += len(raw)
            if held >= OUT:
                yield out(rows)
                rows, held = [], 0
        if rows:
            yield out(rows)


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): runs as (start, length, period), the text without what they repeat."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _find, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text); for every tenth hash of the id, the words from some place on repeat the first of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    # split once into a column: inside one expression it would be split for each use
    some = docs.select("doc_id", "text", F.floor(h / 10).alias("g"),
                       F.when(F.pmod(h, F.lit(10)) == 0, word_array(F.col("text"))).alias("words"))
    a, n = F.pmod("g", F.size("words")).cast("int"), F.size("words")
    some = some.withColumns({"n": n, "a": F.when(n > 0, a)})
    some = some.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.pmod("g", F.lit(8))))).cast("int"))
    rest = F.col("n") - F.col("a")
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")
    return some.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document of ``documents`` after planting, as digests; one row a document."""
    docs = planted(table(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return (find_runs(docs).withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                    (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
                    F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
