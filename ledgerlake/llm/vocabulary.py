"""Source divergence audit over a vocabulary held in minimal acyclic transducers.

A first pass over the texts counts, for each language, the documents of every
term; a term in at least ``MIN_DOCS`` documents of a language is kept and gets an
ordinal, its place in the order of (lang, term) by bytes. Kept terms are dealt
into shards by hash. Of each shard's sorted terms one task builds the minimal
acyclic automaton (equal right languages share a state as soon as no later term
can reach them). Its arcs carry outputs, the number of accepted terms they pass
over, so the sum along a word is the word's place among the shard's sorted terms;
a table of ascending ordinals turns the place into the ordinal.

A second pass streams the texts through the transducers and recounts: a chunk's
distinct words travel packed, a row for each shard, and meet the shard's
transducer in a shuffle. The vocabulary is never broadcast and never collected;
a task holds one transducer at a time. A shard's packs are dealt over ``salts``
tasks, each with its own copy of the transducer. The counts come back by
ordinal, so everything after that sorts and joins integers: ordinals break ties,
and only reported terms are turned into text again.

The audit compares, within a language, each source's smoothed shares of the kept
terms with the shares of every other source and of the language.

Defined results: null text, lang and source count as ''. Repeated rows and ids
are documents of their own. A language without kept terms has pairs of value 0.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import LOWER, chunks, words
from .stage import drop, stage, table

MIN_DOCS, TOP = 30, 50
SHARD_TERMS = 1 << 15                    # terms of a transducer, about
CHUNK = 1 << 22                          # bytes of text packed together
HELD = 1 << 20                           # counts a task holds before it passes them on
CELLS = 1 << 20                          # terms x sources of a block of the comparison
SCALE, SMOOTH = 1_000_000_000, 5

#: Bytes of a term: letters and all non-ASCII characters.
TERM_BYTES = np.zeros(256, dtype=bool)
TERM_BYTES[65:91] = TERM_BYTES[97:123] = TERM_BYTES[128:] = True


# -- terms of a chunk -------------------------------------------------------------------------------------------

def _strings(data: np.ndarray, size: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data)))


def _terms(c):
    """(words of the chunk, distinct terms, number of each word's term, a word that shows each term)."""
    w = words(c, TERM_BYTES)
    low = LOWER[c.buf]
    coded = _strings(low[TERM_BYTES[low]], w.end - w.start).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    show = np.zeros(len(coded.dictionary), np.int64)
    show[code[::-1]] = np.arange(len(code))[::-1]
    return w, coded.dictionary, code, show


def _labels(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = values.cast(pa.string()).fill_null("").dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def _document_counts(batches):
    """Documents of each (lang, term), summed over a chunk."""
    for b in batches:
        lang, langs = _labels(b.column("lang"))
        for c in chunks(b.column("text"), CHUNK):
            w, dictionary, code, _ = _terms(c)
            if not len(code):
                continue
            n = len(dictionary)
            seen = np.unique(w.doc * n + code)
            key, docs = np.unique(lang[c.first + seen // n] * n + seen % n, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs).take(pa.array(key // n)), dictionary.take(pa.array(key % n)).cast(pa.string()), pa.array(docs)],
                ["lang", "term", "docs"])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, ord): terms of enough documents, numbered in the order of (lang, term) by bytes."""
    found = (docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, docs long")
             .groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs))
    # a place within each sorted range; ranges ascend, so the ranges before it give the rest
    placed = stage(found.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
                   .withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    ranges = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # one row for each shuffle partition, whatever the input's size
    before = ranges.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    out = stage(placed.join(F.broadcast(before), part == F.col("part"))
                .select("lang", "term", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("ord")), "terms")
    drop(placed)
    return out


# -- the transducer ---------------------------------------------------------------------------------------------

def minimal_transducer(keys: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct keys; outputs add up to a key's place among them.

    ``arc`` is (state << 8 | byte), ascending; ``to`` and ``out`` its target and
    output; ``final`` marks accepting states; the last state is the root.
    """
    open_states = [[False, []]]                 # along the last key: accepting?, [(byte, state)]
    known: dict[tuple, int] = {}
    accepted, final, rows = [], [], []

    def close(state) -> int:
        mark = (state[0], tuple(state[1]))
        if mark not in known:
            known[mark] = me = len(accepted)
            passed = int(state[0])
            for byte, to in state[1]:
                rows.append((me << 8 | byte, to, passed))
                passed += accepted[to]
            accepted.append(passed)
            final.append(state[0])
        return known[mark]

    last = b""
    for key in keys:
        same, most = 0, min(len(last), len(key))
        while same < most and last[same] == key[same]:
            same += 1
        for depth in range(len(last), same, -1):
            done = close(open_states.pop())
            open_states[-1][1].append((last[depth - 1], done))
        open_states.extend([False, []] for _ in key[same:])
        open_states[-1][0] = True
        last = key
    for depth in range(len(last), 0, -1):
        done = close(open_states.pop())
        open_states[-1][1].append((last[depth - 1], done))
    close(open_states[0])
    arc, to, out = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    return {"arc": arc, "to": to, "out": out, "final": np.array(final, np.int64)}


def walk(t: dict, data: np.ndarray, start: np.ndarray, size: np.ndarray, state=None, place=None) -> tuple[np.ndarray, np.ndarray]:
    """(state or -1, place) after each key data[start:start + size], all keys a byte at a time."""
    state = np.full(len(start), len(t["final"]) - 1) if state is None else state.copy()
    place = np.zeros(len(start), np.int64) if place is None else place.copy()
    live, step = np.flatnonzero((size > 0) & (state >= 0)), 0
    while len(live):
        key = state[live] << 8 | data[start[live] + step]
        at = np.minimum(np.searchsorted(t["arc"], key), max(len(t["arc"]) - 1, 0))
        hit = t["arc"][at] == key if len(t["arc"]) else np.zeros(len(live), bool)
        state[live] = np.where(hit, t["to"][at] if len(t["arc"]) else -1, -1)
        live, at = live[hit], at[hit]
        place[live] += t["out"][at]
        step += 1
        live = live[size[live] > step]
    return state, place


def _shard_of(shards: int):
    def run(batches):
        for b in batches:
            for c in chunks(b.column("term"), CHUNK):
                own = (words(c, TERM_BYTES).hash % np.uint64(shards)).astype(np.int32)
                part = b.slice(c.first, len(c))
                yield pa.RecordBatch.from_arrays([pa.array(own), *part.columns], ["shard", "lang", "term", "ord"])
    return run


def _build(group: pa.Table) -> pa.Table:
    key = [lang.encode() + b"\0" + term.encode() for lang, term in zip(group["lang"].to_pylist(), group["term"].to_pylist())]
    order = sorted(range(len(key)), key=key.__getitem__)
    t = minimal_transducer([key[i] for i in order])
    t["ord"] = group["ord"].to_numpy()[order]
    return pa.table({"shard": group["shard"][:1]} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in t.items()})


PARTS = ("arc", "to", "out", "final", "ord")


def transducers(kept: DataFrame, shards: int) -> DataFrame:
    """(shard, arc, to, out, final, ord): a transducer for each shard; arrays of 64-bit integers."""
    dealt = kept.select("lang", "term", "ord").mapInArrow(_shard_of(shards), "shard int, lang string, term string, ord long")
    return dealt.groupBy("shard").applyInArrow(_build, "shard int, " + ", ".join(f"{p} binary" for p in PARTS))


# -- recounting -------------------------------------------------------------------------------------------------

PACK = "shard int, langs array<string>, sources array<string>, terms binary, sizes binary, word binary, who binary, n binary"


def _packs(shards: int):
    """A chunk's terms and their counts by (lang, source), a row for each shard."""
    def run(batches):
        for b in batches:
            lang, langs = _labels(b.column("lang"))
            source, sources = _labels(b.column("source"))
            for c in chunks(b.column("text"), CHUNK):
                w, _, code, show = _terms(c)
                if not len(code):
                    continue
                rows = slice(c.first, c.first + len(c))
                who, group = np.unique(lang[rows] * len(sources) + source[rows], return_inverse=True)
                key, n = np.unique(group[w.doc] * len(show) + code, return_counts=True)
                term, by = key % len(show), key // len(show)
                own = (w.hash[show] % np.uint64(shards)).astype(np.int64)
                low = LOWER[c.buf]
                for s in np.unique(own):
                    mine = np.flatnonzero(own == s)
                    number = np.full(len(show), -1)
                    number[mine] = np.arange(len(mine))
                    at = number[term] >= 0
                    size = w.end[show[mine]] - w.start[show[mine]]
                    first = np.concatenate([[0], np.cumsum(size)])
                    data = low[np.repeat(w.start[show[mine]] - first[:-1], size) + np.arange(first[-1])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s], pa.int32()),
                         pa.array([[langs[x // len(sources)] for x in who]]), pa.array([[sources[x % len(sources)] for x in who]]),
                         *(pa.array([x.tobytes()], pa.binary()) for x in (data, size.astype(np.int64), number[term[at]], by[at], n[at]))],
                        ["shard", "langs", "sources", "terms", "sizes", "word", "who", "n"])
    return run


class _Counts:
    """Counts by (lang, source) and ordinal, held until there are many."""

    def __init__(self):
        self.who, self.parts, self.held = {}, [], 0

    def add(self, labels, who, ordinal, n):
        number = np.array([self.who.setdefault(x, len(self.who)) for x in labels], np.int64)
        self.parts.append((number[who], ordinal, n))
        self.held += len(n)

    def flush(self):
        if not self.parts:
            return
        who, ordinal, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ordinal, who))
        who, ordinal, n = who[order], ordinal[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(who) != 0) | (np.diff(ordinal) != 0)]))
        if len(first):
            label = list(self.who)
            take = pa.array(who[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in label]).take(take), pa.array([x[1] for x in label]).take(take),
                 pa.array(ordinal[first]), pa.array(np.add.reduceat(n, first))], ["lang", "source", "ord", "n"])
        self.__init__()


def _recount(batches):
    """Stream packs through their shard's transducer, which comes before them in the sorted rows."""
    array = lambda x: np.frombuffer(x, np.int64)
    t, shard, counts = None, None, _Counts()
    for b in batches:
        for i in range(b.num_rows):
            row = {k: b.column(k)[i].as_py() for k in ("shard", *PARTS)}
            if row["arc"] is not None:
                t, shard = {k: array(row[k]) for k in PARTS}, row["shard"]
                continue
            if t is None or shard != row["shard"]:
                continue                                   # no term of this shard is kept
            row |= {k: b.column(k)[i].as_py() for k in ("langs", "sources", "terms", "sizes", "word", "who", "n")}
            data, size = np.frombuffer(row["terms"], np.uint8), array(row["sizes"])
            start = np.cumsum(size) - size
            word, who, n = array(row["word"]), array(row["who"]), array(row["n"])
            lang, langs = _labels(pa.array(row["langs"]))
            for k, name in enumerate(langs):
                head = np.frombuffer(name.encode() + b"\0", np.uint8)
                state, place = walk(t, head, np.zeros(1, np.int64), np.array([len(head)]))
                if state[0] < 0:
                    continue
                mine = np.flatnonzero(lang[who] == k)
                used = np.unique(word[mine])
                state, place = walk(t, data, start[used], size[used], np.full(len(used), state[0]), np.full(len(used), place[0]))
                good = (state >= 0) & (t["final"][state] > 0)
                ordinal = np.full(len(size), -1)
                ordinal[used[good]] = t["ord"][place[good]]
                mine = mine[ordinal[word[mine]] >= 0]
                counts.add(list(zip(row["langs"], row["sources"])), who[mine], ordinal[word[mine]], n[mine])
            if counts.held >= HELD:
                yield from counts.flush()
    yield from counts.flush()


def recount(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, ord, n): occurrences of the kept terms, found by their transducers."""
    spark = docs.sparkSession
    shards = max(1, -(-kept.count() // SHARD_TERMS))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, -(-2 * tasks // shards))
    pack = docs.select("lang", "source", "text").mapInArrow(_packs(shards), PACK)
    pack = pack.withColumn("salt", F.pmod(F.crc32("terms"), F.lit(salts)).cast("int"))
    build = transducers(kept, shards).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = build.withColumn("turn", F.lit(0)).unionByName(pack.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    met = both.repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "turn")
    return (met.mapInArrow(_recount, "lang string, source string, ord long, n long")
            .groupBy("lang", "source", "ord").agg(F.sum("n").alias("n")))


# -- the audit --------------------------------------------------------------------------------------------------

def shares(count: np.ndarray, total, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exact at any size."""
    total = np.asarray(total) + SMOOTH * terms
    if count.size and count.max() < (1 << 62) // SCALE:
        return 1 + SCALE * (count + SMOOTH) // total
    return (1 + SCALE * (count.astype(object) + SMOOTH) // total.astype(object)).astype(np.int64)


def _compare(top: int):
    """Partial sums for the pairs of a block's sources, and each source's foremost terms of the block."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        name = right["source"].to_pylist()
        order = sorted(range(len(name)), key=lambda i: name[i].encode())
        name = [name[i] for i in order]
        total = right["total"].to_numpy()[order]
        low, high, terms = (right[k][0].as_py() for k in ("low", "high", "terms"))
        width = high - low
        count = np.zeros((len(name), width), np.int64)
        number = {x: i for i, x in enumerate(name)}
        at = [number[x] for x in left["source"].to_pylist()]
        count[at, left["ord"].to_numpy() - low] = left["n"].to_numpy()
        out = {k: [] for k in ("source", "item", "ord", "value")}

        def put(source, item, ordinal, value):
            for k, v in zip(out, (source, item, ordinal, value)):
                out[k] += v

        if width:
            p = shares(count, total[:, None], terms)
            q = shares(count.sum(axis=0), total.sum(), terms)
        for i, me in enumerate(name):
            rest = name[i + 1:]
            value = np.abs(p[i + 1:] - p[i]).sum(axis=1).tolist() if width else [0] * len(rest)
            put([me] * len(rest), rest, [None] * len(rest), value)
            if width:
                over = np.flatnonzero((count[i] > 0) & (p[i] > q))
                best = over[np.lexsort((over, -(p[i] - q)[over]))[:top]]
                put([me] * len(best), [None] * len(best), (best + low).tolist(), (p[i] - q)[best].tolist())
        kind = {"source": pa.string(), "item": pa.string(), "ord": pa.int64(), "value": pa.int64()}
        made = {k: pa.array(v, kind[k]) for k, v in out.items()}
        return pa.table({"lang": pa.array([right["lang"][0].as_py()] * len(out["source"]), pa.string())} | made)
    return run


def divergence_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank); see the module and ``shares``."""
    docs = docs.select("text", *(F.coalesce(F.col(k), F.lit("")).alias(k) for k in ("lang", "source")))
    kept = kept_terms(docs, min_docs)
    count = stage(recount(docs, kept), "counts")
    size = kept.groupBy("lang").agg(F.min("ord").alias("base"), F.count("*").alias("terms"))
    group = (docs.groupBy("lang", "source").agg(F.count("*").alias("docs"))
             .join(count.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
             .join(size, "lang", "left")
             .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"),
                     F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("terms", F.lit(0)).alias("terms")))
    group = stage(group, "groups")
    most = group.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    block = max(1, min(4096, CELLS // most))
    base = group.select("lang", "base").distinct()
    left = (count.join(base, "lang").withColumn("block", F.floor((F.col("ord") - F.col("base")) / block))
            .select("lang", "block", "source", "ord", "n"))
    right = (group.withColumn("block", F.explode(F.expr(f"sequence(0L, cast(greatest(terms - 1, 0) div {block} as long))")))
             .withColumn("low", F.col("base") + F.col("block") * block)
             .withColumn("high", F.least(F.col("low") + block, F.col("base") + F.col("terms")))
             .select("lang", "block", "source", "total", "low", "high", "terms"))
    made = stage(left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block"))
                 .applyInArrow(_compare(top), "lang string, source string, item string, ord long, value long"), "compared")

    half = made.where("item is not null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pair = half.union(half.select("lang", "item", "source", "value"))
    by_item = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_item).alias("rank"))
    by_ord = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ord")
    term = (made.where("ord is not null").drop("item").withColumn("rank", F.row_number().over(by_ord)).where(F.col("rank") <= top)
            .join(kept.select("ord", F.col("term").alias("item")), "ord")
            .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
    return pair.union(term)


def op12_transducer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of ``documents`` within each language."""
    return divergence_audit(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row_no,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
w AS (SELECT lang, source, row_no, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row_no) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
total AS (SELECT lang, source, sum(n) AS total FROM dense GROUP BY ALL),
p AS (
  SELECT lang, source, term, n,
         1 + (1000000000::HUGEINT * (n + 5)::HUGEINT) // (total::HUGEINT + 5 * v::HUGEINT) AS p
  FROM dense JOIN total USING (lang, source) JOIN v USING (lang)),
whole AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM dense GROUP BY ALL),
whole_total AS (SELECT lang, sum(n)::HUGEINT AS total FROM whole GROUP BY ALL),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v::HUGEINT) AS q
  FROM whole JOIN whole_total USING (lang) JOIN v USING (lang)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
