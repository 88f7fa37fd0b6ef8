"""Near-duplicates by ProbMinHash over weighted word shingles.

* A text's shingles are its runs of five lower-cased words, weighted by how
  often they occur; a text of one to four words is one shingle.
* **Signature.** Every shingle is a Poisson process with its weight as rate;
  each arrival falls on one of ``SLOTS`` slots at random and a slot keeps the
  shingle of its earliest arrival. Arrivals are drawn in bursts from hashes of
  (shingle, arrival number); a shingle stops as soon as its next arrival is
  later than the latest slot of its text. Two texts agree in a slot with their
  probability Jaccard similarity.
* **Banding**: ``BANDS`` bands of ``ROWS`` slots (a pair at 0.8 shares a band
  with probability 1 - 5e-8). Weighted signatures see probability Jaccard only,
  so a text with a repeated shingle has the bands of a second signature with all
  weights 1 beside them; for the other texts both signatures are one. That holds
  the probability for the set Jaccard too.
* **Verification** is exact, on the shingle multisets of both texts: the pair
  is linked if its probability Jaccard or its set Jaccard similarity reaches
  the threshold.

Which pairs of a bucket are verified: never all, unless it has at most
``SMALL`` texts. First each bucket's hub (the text that shares the most buckets
with others) is compared with its members; linked texts form components. Then
come rounds: the members of every bucket that still holds several components
are sorted by further slots of their signatures, each round by other slots, and
neighbours of different components are compared. Alike texts stand together in
such an order, a pair meets in all the buckets it shares (13 at 0.8), and any
chain of links is enough, so a few rounds join what belongs together. Rounds go
on until one finds no link (three at least); each is linear in the entries.

What is left then, the texts of buckets that still hold several components, is
searched whole by a prefix filter. Shingles have one order, rare ones first. A
text's prefix ends where the shingles from there on hold less than the
threshold of its shingles and of its weight. The first common shingle of a
linked pair stands in both prefixes: all common shingles follow it, and they
hold at least the threshold of either text, by number for the set Jaccard and
by weight for the probability Jaccard. So all pairs of different components
that share a prefix shingle are verified, in blocks of bounded size. Alike
texts have their common shingles behind the prefix unless these alone are the
threshold of a text, so a family of forms gives few pairs, not its square.

Defined results: null and empty texts and texts of white space have no words
and belong to no pair; texts that are equal byte for byte share a class, empty
ones too. Nodes are texts, not ids, so repeated ids or rows do no harm. A class
is named by its smallest doc_id (null if it has none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import SPACE_WORDS, Chunk, chunks, list_array, mix, words
from .components import components
from .stage import drop, stage, table, text_key

K = 5
SLOTS, BANDS = 128, 32
ROWS = SLOTS // BANDS
THRESHOLD = 0.8
SMALL, LEAST_ROUNDS = 8, 3
RANKS, BLOCK = 1 << 20, 256              # slots of the shingle counts; rows of a block
TEXTS = 1024                             # texts that reach a Python worker at once
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_ID_BITS = np.uint64(42)                 # in a chunk: the document above, 42 bits of shingle below


def shingles(c: Chunk, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle id, weight) sorted by document and id; ids have 42 bits."""
    w = words(c, SPACE_WORDS)
    doc, n = w.doc, w.count
    at = np.arange(len(doc)) - w.first[doc]
    h = np.zeros(len(doc), np.uint64)
    padded = np.concatenate([w.hash, np.zeros(k, np.uint64)])
    for j in range(k):
        inside = at + j < n[doc]
        h += np.where(inside, padded[j:j + len(doc)], np.uint64(0)) * _STEP[j % len(_STEP)]
    whole = (at + k <= n[doc]) | (at == 0)
    key = (doc[whole].astype(np.uint64) << _ID_BITS) | (mix(h[whole]) >> np.uint64(64 - 42))
    key, weight = np.unique(key, return_counts=True)
    return (key >> _ID_BITS).astype(np.int64), key & ((np.uint64(1) << _ID_BITS) - np.uint64(1)), weight


def signatures(doc: np.ndarray, ident: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash of each document: (n, slots) shingle ids, 32 bits each; 0 for a text without shingles."""
    best = np.full(n * slots, np.uint64(0xFFFFFFFFFFFFFFFF))
    last = np.full(n, np.inf)
    short = mix(ident) & np.uint64(0xFFFFFFFF)
    time = np.zeros(len(doc))
    rate = 1.0 / weight
    live, drawn, burst = np.arange(len(doc)), 0, 1
    while len(live):
        for _ in range(burst):
            drawn += 1
            r = mix(ident[live] * _STEP[1] + np.uint64(drawn * int(_STEP[0]) % (1 << 64)))
            time[live] -= np.log(((r >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0 ** -52) * rate[live]
            slot = (mix(r) % np.uint64(slots)).astype(np.int64)
            packed = time[live].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | short[live]
            np.minimum.at(best, doc[live] * slots + slot, packed)
        open_docs = np.unique(doc[live])
        worst = best.reshape(n, slots)[open_docs].max(axis=1)
        full = worst != np.uint64(0xFFFFFFFFFFFFFFFF)
        last[open_docs[full]] = (worst[full] >> np.uint64(32)).astype(np.uint32).view(np.float32)
        live = live[time[live] <= last[doc[live]]]
        burst = min(burst * 2, 32)
    sig = (best & np.uint64(0xFFFFFFFF)).reshape(n, slots)
    sig[np.bincount(doc, minlength=n) == 0] = 0
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, slots = sig.shape
    part = sig.reshape(n, bands, slots // bands)
    h = np.full((n, bands), np.arange(1, bands + 1, dtype=np.uint64) * _STEP[2])
    for j in range(part.shape[2]):
        h = mix(h ^ part[:, :, j]) + _STEP[3]
    return mix(h).view(np.int64)


def band_codes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """16 bits of each slot of a band, first slot on top: orders texts by these slots."""
    part = sig.reshape(len(sig), bands, sig.shape[1] // bands)[:, :, :4] & np.uint64(0xFFFF)
    out = np.zeros(part.shape[:2], np.uint64)
    for j in range(part.shape[2]):
        out = (out << np.uint64(16)) | part[:, :, j]
    return out.view(np.int64)


def _bands(batches):
    """Band keys and codes of each text: BANDS of its signature, then BANDS of its unweighted one if it differs
    (null where both have the same key)."""
    for b in batches:
        for c in chunks(b.column("text")):
            doc, ident, weight = shingles(c)
            sig = signatures(doc, ident, weight, len(c))
            some = np.unique(doc)
            repeated = np.unique(doc[weight > 1])
            part = np.isin(doc, repeated)
            plain = signatures(np.searchsorted(repeated, doc[part]), ident[part], np.ones(part.sum(), np.int64), len(repeated))
            first, second = band_keys(sig), band_keys(plain)
            order = np.argsort(np.repeat(np.concatenate([some, repeated]), BANDS), kind="stable")
            keys = np.concatenate([first[some].ravel(), second.ravel()])[order]
            known = np.concatenate([np.zeros(len(some) * BANDS, bool), (second == first[repeated]).ravel()])[order]
            codes = np.concatenate([band_codes(sig)[some].ravel(), band_codes(plain).ravel()])[order]
            n = np.zeros(len(c), np.int64)
            n[some] += BANDS
            n[repeated] += BANDS
            off = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays(
                [b.column("node")[c.first:c.first + len(c)],
                 pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(keys, pa.int64(), mask=known)),
                 list_array(codes, off, pa.int64())], ["node", "bands", "codes"])


def _sets(batches):
    """Shingle ids and weights of each text as packed little-endian arrays."""
    for b in batches:
        for c in chunks(b.column("text")):
            doc, ident, weight = shingles(c)
            off = np.searchsorted(doc, np.arange(len(c) + 1))
            short = (ident >> np.uint64(10)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [b.column("node")[c.first:c.first + len(c)],
                 pa.array([short[i:j].tobytes() for i, j in zip(off, off[1:])], pa.binary()),
                 pa.array([b"" if (weight[i:j] == 1).all() else weight[i:j].astype(np.uint32).tobytes()
                           for i, j in zip(off, off[1:])], pa.binary())], ["node", "ids", "weights"])


def similarity(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """The larger of set Jaccard and probability Jaccard of two weighted sets (ids sorted)."""
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    hit = y[at] == x
    common = int(hit.sum())
    if not common:
        return 0.0
    plain = common / (len(x) + len(y) - common)
    a, b = wx[hit].astype(float), wy[at[hit]].astype(float)
    if wx.max() == 1 and wy.max() == 1:
        return plain              # equal weights: both measures agree
    # for each common d: 1 / sum over all e of max(x_e / x_d, y_e / y_d)
    lone_x, lone_y = wx.sum() - a.sum(), wy.sum() - b.sum()
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    ratio = a / b
    lo = np.searchsorted(ratio, ratio, side="left")
    sum_b = np.concatenate([[0.0], np.cumsum(b)])
    tail_a = np.concatenate([np.cumsum(a[::-1])[::-1], [0.0]])
    # e with a_e / b_e < a_d / b_d count by y, the others by x
    total = lone_x / a + lone_y / b + sum_b[lo] / b + tail_a[lo] / a
    return max(plain, float((1.0 / total).sum()))


def _verify(batches):
    one = lambda raw, n: np.frombuffer(raw, np.uint32) if raw else np.ones(n, np.uint32)
    for b in batches:
        cols = [b.column(k).to_pylist() for k in ("a_ids", "a_weights", "b_ids", "b_weights")]
        sim = np.empty(b.num_rows)
        for i, (ai, aw, bi, bw) in enumerate(zip(*cols)):
            x, y = np.frombuffer(ai, np.uint32), np.frombuffer(bi, np.uint32)
            sim[i] = similarity(x, one(aw, len(x)), y, one(bw, len(y)))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sim)], ["a", "b", "sim"])


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose similarity reaches the threshold. b is the hub of many pairs."""
    side = lambda p: sets.select(F.col("node").alias(p), F.col("ids").alias(f"{p}_ids"), F.col("weights").alias(f"{p}_weights"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return (both.mapInArrow(_verify, "a binary, b binary, sim double")
            .where(F.col("sim") >= threshold).select("a", "b"))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _frequency(batches):
    for b in batches:
        n = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), np.uint32) % RANKS, minlength=RANKS)
        slot = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n[slot])], ["slot", "n"])


def _prefixes(counts, threshold: float):
    """A row for each shingle of a text's prefix; ``rest`` counts the shingles from it on."""
    def run(batches):
        for b in batches:
            taken, rest, found = [], [], []
            for raw, weight in zip(b.column("ids").to_pylist(), b.column("weights").to_pylist()):
                x = np.frombuffer(raw, np.uint32)
                order = np.lexsort((x, counts.value[x % RANKS]))
                after = np.arange(len(x), 0, -1)
                inside = after >= threshold * len(x) - 1e-9
                if weight:
                    mass = np.cumsum(np.frombuffer(weight, np.uint32)[order][::-1].astype(np.int64))[::-1]
                    inside |= mass >= threshold * mass[0] - 1e-9
                taken.append(int(inside.sum()))
                rest.append(after[inside]), found.append(x[order[inside]])
            row = np.repeat(np.arange(b.num_rows), taken)
            size = np.array([len(r) // 4 for r in b.column("ids").to_pylist()], np.int32)
            plain = np.array([not w for w in b.column("weights").to_pylist()], bool)
            cat = lambda parts, t: np.concatenate([np.zeros(0, t), *parts]).astype(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cat(found, np.int64)), b.column("node").take(pa.array(row)), b.column("comp").take(pa.array(row)),
                 pa.array(size[row]), pa.array(cat(rest, np.int32)), pa.array(plain[row])],
                ["shingle", "node", "comp", "size", "rest", "plain"])
    return run


def remaining(live: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs of texts of different components that may reach the threshold: a superset, none is left out."""
    sc = live.sparkSession.sparkContext
    texts = stage(live.select("node", "comp").distinct().join(sets.hint("merge"), "node"), "open")
    seen = texts.select("ids").mapInArrow(_frequency, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(RANKS, np.int64)
    counts[seen.column("slot").to_numpy()] = seen.column("n").to_numpy()
    entry = stage(texts.mapInArrow(_prefixes(sc.broadcast(counts), threshold),
                                   "shingle long, node binary, comp binary, size int, rest int, plain boolean"), "prefixes")
    mixed = (entry.groupBy("shingle").agg(F.count("*").alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y")
             .select("shingle", F.ceil(F.col("n") / BLOCK).cast("int").alias("k")))
    cut = stage(entry.join(mixed.hint("merge"), "shingle").withColumn("own", F.expr("cast(pmod(xxhash64(node), k) as int)")), "cut")
    # every two blocks of a shingle's rows meet once
    part = (cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "k"))
    both = part.alias("p").join(part.alias("q").hint("merge"), F.expr(
        "p.shingle = q.shingle and p.i = q.i and p.j = q.j and p.node < q.node and p.comp != q.comp and (p.i = p.j or p.own != q.own)"))
    # if the shingle is the first common one of two texts without repeats, the rests bound what they have in common
    reach = F.least("p.rest", "q.rest") * (1 + threshold) >= threshold * (F.col("p.size") + F.col("q.size")) - 1e-6
    pairs = stage(both.where(reach | ~(F.col("p.plain") & F.col("q.plain")))
                  .select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct(), "pairs")
    drop(texts, entry, cut)
    return pairs


def _star(comp: DataFrame) -> DataFrame:
    """A link of each node to its component's name, in place of all links found so far."""
    return comp.where("node != comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))


def links(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(verified links between text keys, components of those links)."""
    base = docs.select(text_key().alias("node"), "text")
    sig = stage(base.mapInArrow(_bands, "node binary, bands array<long>, codes array<long>")
                .groupBy("node").agg(F.first(F.struct("bands", "codes")).alias("s")).select("node", "s.*"), "bands", TEXTS)
    entry = sig.select("node", "codes", F.posexplode("bands").alias("band", "bucket")).where("bucket is not null")
    whole = F.col("band") - F.col("band") % BANDS          # where the band's signature begins
    later = [F.element_at("codes", (whole + (F.col("band") + k) % BANDS + 1).cast("int")).alias(f"c{k}") for k in (1, 2, 3)]
    shared = stage(entry.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    member = stage(entry.select("node", "bucket", *later).join(shared.hint("merge"), "bucket"), "members")
    score = member.groupBy("node").agg(F.sum("n").alias("score"))
    score = stage(score, "scores")
    sets = stage(base.join(score.select("node").hint("merge"), "node", "left_semi").mapInArrow(_sets, "node binary, ids binary, weights binary")
                 .groupBy("node").agg(F.first(F.struct("ids", "weights")).alias("s")).select("node", "s.*"), "sets", TEXTS)
    drop(sig, shared)

    top = (member.select("node", "bucket").join(score.hint("merge"), "node")
           .groupBy("bucket").agg(F.max(F.struct("score", "node"))["node"].alias("hub")))
    pairs = stage(member.select("node", "bucket").join(top.hint("merge"), "bucket").where("node != hub")
                  .select(*_ordered("node", "hub")).distinct(), "pairs")
    found = stage(verify(pairs, sets, threshold), "links")
    tested, live, turn = pairs, member, 0
    comp = components(found)
    while True:
        turn += 1
        state = (live.drop("comp").join(comp.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        mixed = state.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("bucket")
        mixed = stage(mixed, "mixed")
        now = stage(state.join(mixed.hint("merge"), "bucket", "left_semi"), "state")
        drop(live, mixed)
        live = now
        code = F.col(f"c{(turn - 1) % 3 + 1}")
        by = 16 * ((turn - 1) // 3 % 4)                  # later rounds begin with another slot
        code = F.shiftleft(code, by).bitwiseOR(F.shiftrightunsigned(code, 64 - by)) if by else code
        # the first slots also cut large buckets into parts of like texts
        line = Window.partitionBy("bucket", F.shiftrightunsigned(code, 56)).orderBy(code, "node")
        near = (live.select("node", "comp", F.lag("node").over(line).alias("other"), F.lag("comp").over(line).alias("other_comp"))
                .where("other_comp != comp").select(*_ordered("node", "other")))
        if turn == 1:
            few = live.where(F.col("n") <= SMALL).select("bucket", "node", "comp")
            both = few.alias("p").join(few.alias("q"), F.expr("p.bucket = q.bucket and p.node < q.node and p.comp != q.comp"))
            near = near.union(both.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")))
        new = stage(near.distinct().join(tested.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        more = stage(verify(new, sets, threshold), "links")
        if turn >= LEAST_ROUNDS and not more.limit(1).count():
            if live.limit(1).count():
                last = remaining(live, sets, threshold)
                rest = stage(verify(last.join(tested.hint("merge"), ["a", "b"], "left_anti"), sets, threshold), "links")
                found, old = stage(found.union(rest), "links"), found
                comp, was = components(_star(comp).union(rest)), comp
                drop(last, rest, old, was)
            drop(new, more, live, sets, score, tested)
            return found, comp
        found, old = stage(found.union(more), "links"), found
        tested, gone = stage(tested.union(new), "tested"), tested
        comp, was = components(_star(comp).union(more)), comp
        drop(old, gone, new, more, was)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per text key: (node, comp), comp the key of its class."""
    _, comp = links(docs, threshold)
    keys = docs.select(text_key().alias("node")).distinct()
    return keys.join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def op6_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: class id, its size in documents and texts, links of the text."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    docs = docs.select("doc_id", "text")
    found, comp = links(docs, threshold)
    rows = docs.select("doc_id", text_key().alias("node"))
    degree = (found.select(F.col("a").alias("node")).union(found.select("b"))
              .groupBy("node").agg(F.count("*").alias("n_links")))
    per_text = (rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
                .join(comp, "node", "left").join(degree, "node", "left")
                .select("node", "low", "copies", F.coalesce("comp", "node").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    per_text = stage(per_text, "texts")
    per_class = per_text.groupBy("comp").agg(F.min("low").alias("class_id"), F.sum("copies").alias("class_docs"),
                                             F.count("*").alias("class_texts"))
    known = stage(per_text.join(per_class, "comp").select("node", "class_id", "class_docs", "class_texts", "n_links"), "classes")
    return rows.join(known, "node").select("doc_id", "class_id", "class_docs", "class_texts", "n_links")


def stage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest id (ties: any one row)."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = docs.select(*cols)
    node = classes(docs)
    first = (docs.select("doc_id", text_key().alias("node")).join(node, "node")
             .groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("k"))
             .select(F.col("k.doc_id").alias("doc_id"), F.col("k.node").alias("node")))
    first = stage(first, "kept")
    keep = docs.withColumn("node", text_key()).join(
        first.withColumnRenamed("doc_id", "first_id"), "node").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    return keep.dropDuplicates(["node"]).select(*cols)
