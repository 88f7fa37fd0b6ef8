"""Removal of repeated byte strings by suffix arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts
anywhere else in the corpus. Windows of that length are cut into *records*: the
window's smallest K-gram hash (leftmost on ties) is its anchor, and a record is
a longest run of windows with one anchor. Equal windows have equal anchors, so
only records whose anchor hash occurs more than once can hold a repeat, and all
windows that could be equal meet under one hash.

1. Anchors are counted by hash; records of hashes that occur once are left out.
2. The remaining records are reduced to distinct ones with their number.
3. Distinct records are dealt to shards by anchor hash; a hash with more than
   ``SPLIT`` records goes to several. Each shard sorts the suffixes of its
   records (Larsson-Sadakane: every round sorts only groups still equal, by
   their rank twice as far on), takes common prefixes by Kasai's rule along
   parallel strips of the text, and finds the windows that stand in it twice or
   whose record occurs twice.
4. Windows of split hashes are merged across shards: the sorted window prints
   of each shard are looked up in those of the others by binary search.
5. The windows found are spread to the documents that hold the records.

Defined results: null and empty texts and texts under 200 bytes lose nothing
and match nothing. Equal texts of 200 bytes or more lose everything; rows are
answered one by one, so repeated rows repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Chunk, chunks, list_array, mix, prefix_hash, span_hash
from .stage import drop, stage, table, text_key

LENGTH, K = 200, 40
SPLIT, SHARD_BYTES = 8192, 1 << 18
CHUNK, TEXTS = 1 << 18, 1024             # bytes of text hashed together; texts that reach a Python worker at once


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value in h[i:i + width], leftmost on ties."""
    at, best, span = np.arange(len(h)), h, 1
    while span < width:
        step = min(span, width - span)
        n = len(best) - step
        right = best[step:step + n] < best[:n]
        at, best = np.where(right, at[step:step + n], at[:n]), np.where(right, best[step:step + n], best[:n])
        span += step
    return at


def records(c: Chunk) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor hash, record hash) of each record of a chunk."""
    n = len(c.buf)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none
    prefix = prefix_hash(c.buf)
    start = np.arange(n - K + 1)
    grams = span_hash(prefix, start, start + K)
    anchor = sliding_argmin(grams, LENGTH - K + 1)          # one for each window start
    doc = np.repeat(np.arange(len(c)), c.size)[:n - LENGTH + 1]
    inside = np.arange(n - LENGTH + 1) + LENGTH <= c.offsets[doc + 1]
    w = np.flatnonzero(inside)
    if not len(w):
        return none, none, none, none, none
    edge = np.ones(len(w), bool)
    edge[1:] = (anchor[w[1:]] != anchor[w[:-1]]) | (w[1:] != w[:-1] + 1)
    first = w[edge]
    last = w[np.append(np.flatnonzero(edge)[1:] - 1, len(w) - 1)]
    a = anchor[first]
    rec = span_hash(prefix, first, last + LENGTH) ^ mix((a - first).astype(np.uint64))
    return doc[first], first, last, grams[a].view(np.int64), rec.view(np.int64)


def _anchors(batches):
    for b in batches:
        for c in chunks(b.column("text"), CHUNK):
            doc, _, _, h, _ = records(c)
            # a document names a hash once, with its number of places
            order = np.lexsort((h, doc))
            edge = np.ones(len(h), bool)
            edge[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            at = np.flatnonzero(edge)
            key = b.column("key")[c.first:c.first + len(c)].take(pa.array(doc[order][at]))
            yield pa.RecordBatch.from_arrays([key, pa.array(h[order][at]), pa.array(np.diff(np.append(at, len(h))))], ["key", "h", "n"])


def _candidates(batches):
    """Distinct records of a text under repeated hashes, with their places and bytes."""
    for b in batches:
        wanted, copies = b.column("hs"), b.column("copies").to_numpy()
        for c in chunks(b.column("text"), CHUNK):
            doc, first, last, h, rec = records(c)
            part = wanted.slice(c.first, len(c))
            sizes = np.diff(part.offsets.to_numpy())
            flat = np.asarray(part.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
            want = np.stack([np.repeat(np.arange(len(c)), sizes), flat], 1)
            pair = np.unique(np.concatenate([want, np.stack([doc, h], 1)]), axis=0, return_inverse=True)[1].ravel()
            keep = np.isin(pair[len(want):], pair[:len(want)])
            doc, first, last, h, rec = doc[keep], first[keep], last[keep], h[keep], rec[keep]
            order = np.lexsort((first, rec, h, doc))
            doc, first, last, h, rec = doc[order], first[order], last[order], h[order], rec[order]
            edge = np.ones(len(h), bool)
            edge[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (rec[1:] != rec[:-1])
            at = np.flatnonzero(edge)
            raw = c.buf.tobytes()
            for lo in range(0, len(at), 20_000):
                k = at[lo:lo + 20_000]
                off = np.append(k, at[lo + 20_000] if lo + 20_000 < len(at) else len(h))
                d = doc[k]
                yield pa.RecordBatch.from_arrays(
                    [b.column("key")[c.first:c.first + len(c)].take(pa.array(d)), pa.array(h[k]), pa.array(rec[k]),
                     list_array((first - c.offsets[doc])[off[0]:off[-1]], off - off[0], pa.int32()),
                     pa.array(np.diff(off) * copies[c.first + d]),
                     pa.array([raw[i:j + LENGTH] for i, j in zip(first[k], last[k])], pa.binary())],
                    ["key", "h", "rec", "at", "n", "body"])


def big_endian(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, zeros past the end."""
    wide = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(buf), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | wide[j:j + len(buf)]
    return out


def suffix_array(buf: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes or more, by Larsson-Sadakane refinement."""
    n = len(buf)
    key = big_endian(buf)
    sa = np.argsort(key).astype(np.int32)
    ranked = key[sa]
    edge = np.ones(n, bool)
    edge[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    h = 8
    while h < depth:
        last = np.append(edge[1:], True)
        live = np.flatnonzero(~(edge & last))               # places of groups that are still equal
        if not len(live):
            break
        who = sa[live]
        ahead = rank[np.minimum(who + h, n)]
        group = rank[who]
        order = np.argsort(group.astype(np.int64) << 32 | (ahead + 1))
        sa[live] = who[order]
        new = np.ones(len(live), bool)
        new[1:] = (ahead[order][1:] != ahead[order][:-1]) | (group[order][1:] != group[order][:-1])
        edge[live] = new
        rank[sa[live]] = np.maximum.accumulate(np.where(new, live, 0))
        h *= 2
    return sa


def kasai(buf: np.ndarray, order: np.ndarray, cap: int = LENGTH, strips: int = 4096) -> np.ndarray:
    """Common prefix, at most ``cap``, of each suffix in ``order`` with the one before it.

    Kasai's rule along strips of the text that advance side by side: where the
    neighbour of position i is the one of i - 1 moved on, the prefix is known to
    be at most one shorter, and only what lies behind it is compared.
    """
    n = len(buf)
    wide = np.concatenate([buf, np.zeros(cap + 8, np.uint8)])
    word = big_endian(wide)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int32)
    size = max(-(-n // strips), 1)
    lane = np.arange(0, n, size)
    for t in range(size):
        i = lane + t
        i = i[i < n]
        j = before[i]
        i, j = i[j >= 0], j[j >= 0]
        if not len(i):
            continue
        known = np.where((i % size > 0) & (before[i - 1] == j - 1) & (j > 0), np.maximum(out[i - 1] - 1, 0), 0)
        live = np.arange(len(i))
        while len(live):
            same = word[i[live] + known[live]] == word[j[live] + known[live]]
            known[live[same]] += 8
            rest = live[~same]
            if len(rest):
                diff = word[i[rest] + known[rest]] ^ word[j[rest] + known[rest]]
                # whole equal bytes at the top: 7 - (highest set bit) // 8
                top = np.zeros(len(rest), np.int64)
                for k in range(1, 8):
                    top += diff >> np.uint64(64 - 8 * k) == 0
                known[rest] += top
            live = live[same]
            live = live[known[live] < cap]
        out[i] = np.minimum(known, cap)
    lcp = out[order]
    lcp[:1] = 0
    return lcp


def repeated_windows(bodies: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, window, found) for the windows of a shard; found: it stands twice in the corpus as far as the shard knows."""
    size = np.array([len(b) for b in bodies])
    buf = np.frombuffer(b"".join(bodies), np.uint8)
    owner = np.repeat(np.arange(len(bodies)), size)
    begin = np.cumsum(size) - size
    at = np.arange(len(buf)) - begin[owner]
    sa = suffix_array(buf)
    sa = sa[(at + LENGTH <= size[owner])[sa]]               # windows inside one record
    same = kasai(buf, sa) >= LENGTH
    cls = np.cumsum(~same) - 1
    many = np.bincount(cls, weights=n[owner[sa]]) >= 2
    return owner[sa], at[sa], many[cls]


def _shards(size: int):
    """Whole anchor groups, in order, a shard of about ``size`` bytes at a time."""
    def run(batches):
        rows, held, last = [], 0, None

        def flush():
            h = np.array([r[0] for r in rows], np.int64)
            rec = np.array([r[1] for r in rows], np.int64)
            n = np.array([r[2] for r in rows], np.int64)
            salts = np.array([r[3] for r in rows], np.int64)
            split = np.array([r[5] for r in rows], bool)
            bodies = [r[4] for r in rows]
            who, at, found = repeated_windows(bodies, n)
            order = np.lexsort((at, who))
            who, at, found = who[order], at[order], found[order]
            # runs of found windows
            w, a = who[found], at[found]
            edge = np.ones(len(w), bool)
            edge[1:] = (w[1:] != w[:-1]) | (a[1:] != a[:-1] + 1)
            k = np.flatnonzero(edge)
            end = a[np.append(k[1:] - 1, len(a) - 1)] if len(a) else a
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[w[k]]), pa.array(rec[w[k]]), pa.array(a[k].astype(np.int32)), pa.array((end + 1).astype(np.int32)),
                 pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int64())], ["h", "rec", "lo", "hi", "print", "shard"])
            s = split[who]
            if s.any():
                w, a = who[s], at[s]
                buf = np.frombuffer(b"".join(bodies), np.uint8)
                begin = np.cumsum([0, *map(len, bodies)])[:-1]
                p = begin[w] + a
                prints = span_hash(prefix_hash(buf), p, p + LENGTH).view(np.int64)
                for lo in range(0, len(w), 100_000):
                    z = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[w[z]]), pa.array(rec[w[z]]), pa.array(a[z].astype(np.int32)), pa.array((a[z] + 1).astype(np.int32)),
                         pa.array(prints[z]), pa.array(salts[w[z]])], ["h", "rec", "lo", "hi", "print", "shard"])

        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in ("h", "rec", "n", "salt", "body", "split"))):
                if held >= size and (r[0], r[3]) != last:
                    yield from flush()
                    rows, held = [], 0
                rows.append(r)
                held += len(r[4])
                last = (r[0], r[3])
        if rows:
            yield from flush()
    return run


def _merge(t: pa.Table) -> pa.Table:
    """Windows of one hash and slot that other shards hold too, by binary search in their sorted prints."""
    shard, prints = t.column("shard").to_numpy(), t.column("print").to_numpy()
    every = np.sort(prints)
    hit = np.zeros(len(prints), bool)
    for s in np.unique(shard):
        own = np.flatnonzero(shard == s)
        mine = np.sort(prints[own])
        total = np.searchsorted(every, prints[own], "right") - np.searchsorted(every, prints[own], "left")
        inside = np.searchsorted(mine, prints[own], "right") - np.searchsorted(mine, prints[own], "left")
        hit[own] = total > inside
    return t.select(["h", "rec", "lo", "hi"]).filter(pa.array(hit))


def _remove(batches):
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for b in batches:
        out = [[], [], [], []]
        for text, spans in zip(b.column("text"), b.column("spans")):
            raw = (text.as_py() or "").encode()
            gone = np.zeros(len(raw) + 1, np.int32)
            v = spans.values
            if v is not None and len(v):
                np.add.at(gone, v.field(0).to_numpy(), 1)
                np.add.at(gone, v.field(1).to_numpy(), -1)
            gone = np.cumsum(gone)[:-1] > 0
            kept = np.frombuffer(raw, np.uint8)[~gone]
            out[0].append(len(raw)), out[1].append(int(gone.sum()))
            out[2].append(int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum()))
            out[3].append(hashlib.sha256(kept.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3])],
                                         ["doc_id", *names[1:]])


def repeats(docs: DataFrame) -> DataFrame:
    """key, spans: byte ranges of each distinct text that lie in repeated windows (no row: none)."""
    base = docs.select(text_key().alias("key"), "text").where(F.octet_length("text") >= LENGTH)
    anchors = stage(base.mapInArrow(_anchors, "key binary, h long, n long"), "anchors", TEXTS)
    often = stage(anchors.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "hashes")
    wanted = anchors.join(often.hint("merge"), "h").groupBy("key").agg(F.collect_set("h").alias("hs"))
    texts = base.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    cand = stage(texts.join(wanted.hint("merge"), "key").mapInArrow(
        _candidates, "key binary, h long, rec long, at array<int>, n long, body binary"), "records", TEXTS)
    drop(anchors)
    distinct = cand.groupBy("h", "rec").agg(F.sum("n").alias("n"), F.first("body").alias("body"))
    width = stage(cand.select("h", "rec").distinct().groupBy("h").agg(F.count("*").alias("records")), "widths")
    shard = (distinct.join(width.hint("merge"), "h")
             .withColumn("split", F.col("records") > SPLIT)
             .withColumn("salt", F.pmod(F.xxhash64("rec"), F.ceil(F.col("records") / SPLIT).cast("long"))))
    found = stage(shard.select("h", "salt", "rec", "n", "split", "body").repartition("h", "salt").sortWithinPartitions("h", "salt")
                  .mapInArrow(_shards(SHARD_BYTES), "h long, rec long, lo int, hi int, print long, shard long"), "windows")
    # a record has at most LENGTH windows under a hash, so a slot holds a bounded number of them
    crossed = (found.where("print is not null").join(width.hint("merge"), "h")
               .withColumn("slot", F.pmod("print", F.ceil(F.col("records") / SPLIT).cast("long")))
               .groupBy("h", "slot").applyInArrow(_merge, "h long, rec long, lo int, hi int"))
    marks = (found.where("print is null").select("h", "rec", "lo", "hi").union(crossed)
             .groupBy("h", "rec").agg(F.collect_list(F.struct("lo", "hi")).alias("w")))
    marks = stage(marks, "marks")
    spans = F.flatten(F.transform("at", lambda a: F.transform("w", lambda x: F.struct(
        (a + x["lo"]).alias("lo"), (a + x["hi"] + (LENGTH - 1)).alias("hi")))))
    out = (cand.select("key", "h", "rec", "at").join(marks.hint("merge"), ["h", "rec"])
           .groupBy("key").agg(F.flatten(F.collect_list(spans)).alias("spans")))
    out = stage(out, "spans")
    drop(often, cand, width, found, marks)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = docs.withColumn("key", text_key()).join(repeats(docs), "key", "left")
    return both.select("doc_id", "text", "spans").mapInArrow(
        _remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
