"""Periodic runs, the transducer audit and SimHash against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlake.llm import runs, simhash, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ord long, print long, words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, so, 0, 7, 8, "x") for i, t, la, so in rows], SCHEMA).repartition(3)


# -- periodic runs ----------------------------------------------------------------------------------------------

def brute_lyndon(x):
    out = []
    for i in range(len(x)):
        j = i + 1
        while j < len(x) and x[j:] > x[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(x):
    found = []
    for q in range(1, len(x) // 4 + 1):
        s = 0
        while s + q < len(x):
            e = s
            while e + q < len(x) and x[e] == x[e + q]:
                e += 1
            size = e + q - s
            smaller = any(all(x[s + k] == x[s + k + d] for k in range(size - d)) for d in range(1, q))
            if e > s and size >= max(6, 4 * q) and not smaller:
                found.append((s, size, q))
            s = e + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_sequence(rng):
    x = [rng.randint(0, rng.choice([0, 1, 1, 2, 3])) for _ in range(rng.randint(0, 40))]
    return x[:rng.randint(0, len(x))] + (x[:rng.randint(1, 7)] * 9)[:rng.randint(0, 40)] + x


def test_lyndon_groups_and_runs():
    rng = random.Random(1)
    for _ in range(600):
        x = some_sequence(rng)
        assert runs.lyndon_array(x) == brute_lyndon(x)
        assert runs.text_runs(np.array(x, np.int64)) == brute_runs(x)
    # Fibonacci and Thue-Morse words, and a long period
    fib, tm = [0], [0]
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    fib = b
    for _ in range(7):
        tm = tm + [1 - v for v in tm]
    for x in (fib, tm, list(range(40)) * 5 + [3], [1] * 50 + [0] + [1] * 5):
        assert runs.text_runs(np.array(x, np.int64)) == brute_runs(x)


RUN_ROWS = [(i, t, "en", "s") for i, t in [
    (1, "a b " * 5), (1, "a b " * 5), (2, "x"), (3, None), (4, ""), (5, " \n\t "), (None, "q " * 8), (6, "a b " * 7 + "\x0bz"),
    *((k, " ".join(f"w{j * 37 % 50}" for j in range(3 + k))) for k in range(7, 90)),
    (99, " ".join(f"w{j}" for j in range(9000)) + " p q r" * 4000)]]


def test_op11(spark, monkeypatch):
    monkeypatch.setattr(runs, "table", lambda *_: frame(spark, RUN_ROWS))
    got = {}
    for r in runs.op11_lyndon_runs(spark, "").collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    want = collections.defaultdict(list)
    for i, t, *_ in RUN_ROWS:
        words = re.findall("[^\\x20\\x09-\\x0D]+", t or "")
        n = len(words)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        if n > 5000:                     # long: by period only where words repeat
            found = [(9000, 12000, 3)] if h % 10 else runs.text_runs(np.unique(words, return_inverse=True)[1])
        else:
            found = brute_runs(words)
        keep = [k for k in range(n) if not any(s + q <= k < s + size for s, size, q in found)]
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        want[i].append((len(found), *best, best[1] and 1000 * best[1] // best[2],
                        hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()).hexdigest(),
                        hashlib.sha256(" ".join(words[k] for k in keep).encode()).hexdigest()))
    assert got == dict(want)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in RUN_ROWS if i) > 3
    empty = runs.find_runs(frame(spark, RUN_ROWS).where("false"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "runs", "collapsed"]


# -- transducer vocabulary --------------------------------------------------------------------------------------

def test_minimal_transducer():
    rng = random.Random(2)
    keys = sorted({bytes(rng.choice(b"abc\xc3") for _ in range(rng.randint(1, 7))) for _ in range(500)} | {b"ing" * 50})
    t = vocabulary.minimal_transducer(keys)
    probe = keys + [k + b"z" for k in keys[:50]] + [k[:-1] for k in keys if len(k) > 1]
    data = np.frombuffer(b"".join(probe), np.uint8)
    size = np.array([len(k) for k in probe])
    state, place = vocabulary.walk(t, data, np.cumsum(size) - size, size)
    for k, s, p in zip(probe, state, place):
        found = s >= 0 and t["final"][s] > 0
        assert found == (k in set(keys))
        if found:
            assert keys[p] == k
    # minimal: states are the distinct right languages
    rights = {frozenset(k[i:] for k in keys if k.startswith(p)) for q in keys for i in range(len(q) + 1) for p in [q[:i]]}
    assert len(t["final"]) == len(rights)


def brute_audit(rows, min_docs, top):
    docs = [(la or "", so or "", re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
            for _, t, la, so in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = collections.Counter(w for d in mine for w in set(d[2]))
        kept = sorted((w for w in seen if seen[w] >= min_docs), key=str.encode)
        count = {s: collections.Counter(w for d in mine if d[1] == s for w in d[2]) for s in {d[1] for d in mine}}
        whole = sum(count.values(), collections.Counter())

        def share(c):
            total = sum(c[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 10 ** 9 * (c[w] + 5) // total for w in kept}

        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            pair = sorted(((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in count if o != s))
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pair)}
            term = sorted((q[w] - p[s][w], w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w])[:top]
            out |= {(lang, s, "term", w, -v, k + 1) for k, (v, _, w) in enumerate(term)}
    return out


def audit_rows():
    rng = random.Random(3)
    vocab = ["der", "Die", "das", "é", "É", "naïve", "x1y", "a_b", "中文", "zz", "Zz", "\U0001f600", "�"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 25))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None, "z"]))
            for k in range(300)]
    rows += [(5, None, "fr", "a"), (5, "", "fr", "b"), (None, "solo", "fr", None), (7, "long " * 40000, "en", "rare"), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("shard, cells", [(1 << 15, 1 << 20), (4, 16)])
def test_audit(spark, monkeypatch, shard, cells):
    monkeypatch.setattr(vocabulary, "SHARD_TERMS", shard)
    monkeypatch.setattr(vocabulary, "CELLS", cells)
    monkeypatch.setattr(vocabulary, "HELD", 50)
    rows = audit_rows()
    got = vocabulary.divergence_audit(frame(spark, rows), 8, 5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    want = brute_audit(rows, 8, 5)
    assert len(got) == len(want) and set(got) == want
    assert vocabulary.divergence_audit(frame(spark, rows).where("false"), 8).count() == 0


def test_shares_are_exact_beyond_64_bits():
    count = np.array([0, 10 ** 11, 3 * 10 ** 12 + 1])
    total = int(count.sum())
    assert vocabulary.shares(count, total, 3).tolist() == [1 + 10 ** 9 * (int(c) + 5) // (total + 15) for c in count]


# -- SimHash ----------------------------------------------------------------------------------------------------

def brute_print(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    prints = sorted(prints)
    for i, p in enumerate(prints):
        for q in prints[i + 1:]:
            if (p ^ q).bit_count() <= 2:
                a, b = sorted((find(p), find(q)))
                root[b] = a
    return {p: find(p) for p in prints}


def test_op13(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, t, "en", "s") for i, t in [(3, None), (2, ""), (9, " \n "), (4, "One"), (5, "one"), (6, "a B"), (None, "a b"), (None, "null only"), (8, "é ß z q"), (8, "é ß z q")]]
    for k in range(60):
        base = [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 60))]
        rows.append((100 + k, " ".join(base), "en", "s"))
        rows.append((300 + k, "  ".join(base).upper() + "\n", "en", "s"))
        if len(base) > 20:
            rows.append((500 + k, " ".join(base * 9 + ["end"]), "en", "s"))
    rows.append((900, " ".join(f"v{j}" for j in range(30000)), "en", "s"))
    monkeypatch.setattr(simhash, "table", lambda *_: frame(spark, rows))
    got = sorted(map(tuple, simhash.op13_simhash(spark, "").collect()), key=str)
    prints = {t: brute_print(t) for _, t, *_ in rows}
    comp = components_of(set(prints.values()))
    low = {}
    for i, t, *_ in rows:
        c = comp[prints[t]]
        if i is not None:
            low[c] = min(i, low.get(c, i))
    assert got == sorted(((i, f"{prints[t]:016x}", low.get(comp[prints[t]])) for i, t, *_ in rows), key=str)
    assert simhash.near_duplicates(frame(spark, rows).where("false")).count() == 0


def test_index_finds_every_link(spark, monkeypatch):
    """Random fingerprints with planted neighbours, and one dense ball, with short lists kept very short."""
    monkeypatch.setattr(simhash, "LIST", 4)
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:60]:
        for _ in range(rng.randint(1, 4)):
            prints.add(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    centre = rng.getrandbits(64)
    prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(400)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    link = simhash.links(spark.createDataFrame(signed, "print long").repartition(5))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for r in link.collect():
        a, b = (v % (1 << 64) for v in r)
        assert (a, b) and a in prints and b in prints
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = components_of(prints)
    assert {p: find(p) for p in prints} == want
    assert len(set(want.values())) < len(prints)
    assert link.select(F.col("a")).distinct().count() > 200


def test_positions_cover_every_two_spoilt_bytes():
    for i in range(8):
        for j in range(8):
            short = [k for k, s in enumerate(simhash.SHORT) if not {i, j} & set(s)]
            assert short
            assert any(not {i, j} & set(simhash.LONG[6 * k + m]) for k in short for m in range(6))
