"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties and extra columns."""

import collections
import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerlake.llm import decontaminate, divergence, licenses, mixing, neardup, pii, quality, suffix, tokens, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, row long, h long"
BODY = " ".join(f"word{i * 7919 % 997}" for i in range(120))
TEXTS = [
    (1, BODY), (2, BODY), (3, BODY.replace("word7", "other")), (4, None), (5, ""), (6, " \n\t "), (7, "é" * 50), (8, "one two"),
    (None, "a null id"), (9, "x" * 450), (9, "x" * 450), (10, BODY + " Licensed under CC BY-NC 4.0. All rights reserved."),
    (11, "mail me@x.org or +1 (771) 555-1655 card 4111 1111 1111 1111 at 10.0.0.1\nsame\nsame"), (12, "a b c a b c a b c d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if n % 3 else None, None if n % 4 == 0 else f"s{n % 2}", 0, "x", "y", 1, 2)
                                  for n, (i, t) in enumerate(TEXTS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("split, shard", [(8192, 1 << 19), (2, 4000)])
def test_suffix_repeats(docs, empty, monkeypatch, split, shard):
    monkeypatch.setattr(suffix, "SPLIT", split)          # hashes with more records are split and merged across shards
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    assert suffix.remove_repeats(empty).count() == 0
    raw = [(i, (t or "").encode()) for i, t in TEXTS]
    seen = collections.Counter(b[p:p + 200] for _, b in raw for p in range(len(b) - 199))
    want = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p:p + 200]] > 1:
                gone[p:p + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((str(i), len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    got = [(str(r.doc_id), *r[1:]) for r in suffix.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want)


def test_suffix_array_and_kasai():
    rng = np.random.default_rng(3)
    buf = np.frombuffer(bytes(rng.integers(97, 99, 300).astype(np.uint8)) * 3, np.uint8)
    sa = suffix.suffix_array(buf)
    raw = buf.tobytes()
    cut = [raw[i:i + 200] for i in sa]
    assert sorted(sa) == list(range(len(raw))) and cut == sorted(cut)
    lcp = suffix.kasai(buf, sa)
    for k in range(1, len(sa)):
        a, b = raw[sa[k - 1]:] + b"\0" * 300, raw[sa[k]:] + b"\0" * 300
        n = next((j for j in range(200) if a[j] != b[j]), 200)
        assert lcp[k] == n


def test_tokens_round_trip(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {str(i): tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in TEXTS}
    got = sorted(tokens.token_output(spark, docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        ids = np.array(want[str(r.doc_id)], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokens.token_output(spark, empty).count() == 0
    rng = np.random.default_rng(1)
    parts = [np.append(rng.integers(0, 9, n), 0).astype(np.uint32) for n in (0, 5000, 1, 3000)] + [np.zeros(2000, np.uint32)]
    block = tokens.Block(tokens.pack([None, 1, 2, 3, 4], parts, 50257))
    assert block.ids[0] is None and len(block.rules) > 5 and len(block.symbols) < len(block.tokens())
    for i, p in enumerate(parts):
        assert (block.doc(i) == p).all()


def test_repair_runs_until_no_pair_is_frequent():
    ids = np.tile(np.random.default_rng(6).integers(1, 50000, 512), 400).astype(np.uint32)
    symbols, _, rules = tokens.repair(ids, np.array([0, len(ids)]), 50257)
    pair, n = np.unique(np.stack([symbols[:-1], symbols[1:]]), axis=1, return_counts=True)
    assert len(symbols) <= 16 and not len(n) or n.max() < tokens.MIN_COUNT
    assert tokens.expansion_lengths(rules, 50257)[symbols].sum() == len(ids)


def test_encoder_equals_the_library(monkeypatch):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "MEMO", 40)              # memories turn over all the time
    enc, r = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    bits = ["a", "b", "é", "ß", "ǅ", "中", "ª", "µ", "×", "́", "🎉", " ", " ", "  ", " '", "\n", "\n\n", "\t", "\r\n", "\x00", "\x1c", "\x85",
            "\u00a0", "\u3000", ".", ",", "'s", "'", "'ll", "_", "-", "!", "1", "23", "²", "½", "<|endoftext|>", "word", "y" * 70]
    texts = ["".join(r.choices(bits, k=r.randint(0, 12))) for _ in range(4000)]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))      # none of the encoder's settings
    texts += ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x"]
    for t, got in zip(texts, enc(texts)):
        assert got.tolist() == plain.encode(t, add_special_tokens=False).ids + [0], repr(t)
    assert max(len(m) + len(m.before) for m in (enc.word, enc.piece, enc.head)) <= 80


def test_new_words_are_merged_together(monkeypatch):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path, r, calls = public_tokenizers.path("byte_bpe_50k.json"), random.Random(8), []
    plain = Tokenizer.from_file(path)

    class Counted:
        def __init__(self, tok):
            self.tok = tok

        def encode_batch_fast(self, texts, **kw):
            calls.append(len(texts))
            return self.tok.encode_batch_fast(texts, **kw)

    def word():
        return "".join(r.choices("abcdeéßñ", k=r.randint(3, 12))) + r.choice(["", "", "", ".", "?!", "-x", "'s", "7"])

    gaps = [" "] * 30 + ["\n", "\n\n"]
    texts = ["".join(word() + r.choice(gaps) for _ in range(60)) for _ in range(100)]
    gaps += ["\n ", "  ", " \n", "\t", " \t "]
    texts += ["".join(word() + r.choice(gaps) for _ in range(60)) for _ in range(100)]
    texts += ["", " ", "\n", "\n\n", " \n", "\n ", "a ", " a", "\na", "a\n", "a\n\nb", "a\n b", "a \nb", "a\n  b", "a  b", "\ta b", "a\t b", "a b\t"]
    want = [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    enc = tokens.Encoder(path)
    enc.merges = Counted(enc.merges)
    assert [g.tolist() for g in enc(texts)] == want
    assert len({w for t in texts for w in t.split()}) > 5000 and sum(calls) < 500      # a call for each new word before
    enc = tokens.Encoder(path)
    enc.together = 1                                     # as with a vocabulary that merges the parting byte
    assert [g.tolist() for g in enc(texts)] == want


def test_repair_recounts_only_beside_new_symbols(monkeypatch):
    seen, count = [], tokens._frequent
    monkeypatch.setattr(tokens, "_frequent", lambda keys, least: seen.append(len(keys)) or count(keys, least))
    ids = np.random.default_rng(2).zipf(1.3, 60_000).clip(max=50_000).astype(np.uint32)
    ends = np.array([0, 7, 20_000, len(ids)])
    symbols, off, rules = tokens.repair(ids, ends, 50257, top=50)
    flat = [[i] for i in range(50257)]
    for a, b in rules.tolist():
        flat.append(flat[a] + flat[b])
    docs = [[i for s in symbols[a:z].tolist() for i in flat[s]] for a, z in zip(off, off[1:])]
    assert docs == [ids[a:z].tolist() for a, z in zip(ends, ends[1:])]
    assert (tokens.expansion_lengths(rules, 50257) == [len(f) for f in flat]).all()
    assert len(seen) > 4 and sum(seen) < 3 * len(ids)     # all places in each round before


def test_near_duplicates(docs, empty):
    assert neardup.near_duplicates(empty).count() == 0
    got = collections.defaultdict(set)
    for r in neardup.near_duplicates(docs).collect():
        got[r.class_id].add(r.doc_id)
    a, b = BODY.split(), (BODY + " licensed under cc by-nc 4.0. all rights reserved.").split()
    x, y = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    assert len(x & y) / len(x | y) >= 0.8
    assert {1, 2, 10} <= got[1] and got[9] == {9} and {4, 5} == got[4] and got[6] == {6}


def test_probability_jaccard():
    rng = np.random.default_rng(5)
    for _ in range(20):
        x, y = np.unique(rng.integers(0, 30, 20)), np.unique(rng.integers(0, 30, 20))
        wx, wy = rng.integers(1, 4, len(x)), rng.integers(1, 4, len(y))
        p, q = dict(zip(x, wx)), dict(zip(y, wy))
        every = set(p) | set(q)
        want = sum(1 / sum(max(p.get(e, 0) / p[d], q.get(e, 0) / q[d]) for e in every) for d in set(p) & set(q))
        plain = len(set(p) & set(q)) / len(every)
        assert neardup.similarity(x, wx, y, wy) == pytest.approx(max(want, plain))


def test_quality_learns_and_survives_gaps(spark, docs, empty):
    good = [(100 + i, f"plain words of text number {i} with more to read here", "en", "s", 0, "", "", 0, 0) for i in range(60)]
    bad = [(500 + i, "### $$$ !!! " * (3 + i % 5), "en", "s", 0, "", "", 0, 0) for i in range(60)]
    both = spark.createDataFrame(good + bad, SCHEMA)
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad] + [(None, 1), (501, None)], "doc_id long, quality int")
    model = quality.fit(both, labels)
    for r in quality.score(both, model, ["doc_id"]).collect():
        assert (r.score >= quality.THRESHOLD) == (r.doc_id < 500)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model, ["doc_id"]).collect())
    none = quality.fit(empty, labels)
    assert quality.score(docs, none, ["doc_id"]).count() == len(TEXTS)


def test_quality_counts_in_bounded_memory(monkeypatch):
    texts = [BODY[i % 50:] * 3 for i in range(900)] + [None, "", "a B 1!"] * 700
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    codes = lambda: [x for b in quality._codes([batch]) for x in b.column("codes").to_pylist()]
    want = codes()                           # the tables of powers are made at the first call
    tracemalloc.start()
    try:
        assert codes() == want
        assert tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()
    monkeypatch.setattr(quality, "PART_DOCS", 1)
    assert codes() == want


def test_quality_sends_the_text_once(docs):
    model = quality.Model(np.zeros((quality.GRAMS, quality.LEVELS)), 0.0, 1.0, 0.0)
    for keep in (["doc_id"], ["doc_id", "text", "lang"]):
        got = quality.score(docs, model, keep)
        assert got.columns == [*keep, "score"]
        plan = got._jdf.queryExecution().analyzed().toString()
        assert plan.count("text#") == plan.replace("_text#", "").count("text#")
        assert sorted(map(str, got.select(*keep).collect())) == sorted(map(str, docs.select(*keep).collect()))


def test_temporal_lists(spark):
    cap = spark.createDataFrame([(1, "a.b.com", 5), (2, "a.b.com", 15), (3, "b.com", 12), (4, "", 3), (5, None, 3), (6, "a.b.com", None)],
                                "page_id long, host string, day long")
    entries = spark.createDataFrame([("a.b.com", 3, True), ("a.b.com", 10, False), ("b.com", 12, True), (None, 1, True)],
                                    "pattern string, day long, active boolean")
    got = {r.page_id: r.pattern for r in urls.as_of(cap, entries).collect()}
    assert got == {1: "a.b.com", 2: "b.com", 3: "b.com", 4: None, 5: None, 6: None}
    assert urls.as_of(cap, entries.limit(0)).where("blocked").count() == 0


def test_personal_data(docs, empty):
    assert pii.find(empty).count() == 0
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    text = dict(TEXTS)[11]
    assert [(pii.BASE[s.kind], text[s.start:s.end]) for s in got[11].base] == [
        ("email", "me@x.org"), ("phone", "+1 (771) 555-1655"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.1")]
    assert got[4].base == [] and got[5].base == []


def test_distribution_rules(docs, empty):
    assert divergence.judge(empty).count() == 0
    space = re.compile(r"[^\x20\x09-\x0D]+")
    want = []
    for i, t in TEXTS:
        w, lines = space.findall(t or ""), [x for x in (t or "").split("\n") if space.search(x)]
        grams = list(zip(w, w[1:], w[2:]))
        n = collections.Counter(grams)
        hit = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        want.append((str(i), len(w), sum(map(len, w)), sum(c in divergence.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), len(hit),
                     len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    got = [(str(r.doc_id), *r[1:7]) for r in divergence.judge(docs).collect()]
    assert sorted(got) == sorted(want)


def test_mix_meets_targets(spark, docs, empty):
    def run(d):
        return mixing.plan(d.select("doc_id", mixing.source_key().alias("skey"), mixing.n_words(d["text"]).alias("size")), block=5)

    assert run(empty).count() == 0
    one, two = run(docs).collect(), run(docs).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    by = collections.defaultdict(list)
    for r in one:
        by[r.target].append(r)
        assert r["full"] * r["size"] + r["extra"] <= 2 * r["size"]
    total = sum(r["size"] for r in one)
    assert sum(t for t in by) == pytest.approx(1.5 * total)
    for t, rs in by.items():
        assert abs(sum(r["full"] * r["size"] + r["extra"] for r in rs) - t) <= 10


def test_license_labels(docs, empty):
    assert licenses.scan(empty).count() == 0
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[10].base_labels == "cc-by,reserved" and "cc-by-nc-4.0" in got[10].labels and got[10].n_base == 2
    assert got[4].n_words == 0 and got[4].labels == "" and got[4].first_word is None


def test_benchmark_recall(spark, docs, empty):
    rng = np.random.default_rng(2)
    items = [" ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 10))) for _ in range(25)) for _ in range(40)]
    edited = []
    for t in items:
        z = list(t)
        for _ in range(int(0.05 * len(t))):
            z[rng.integers(len(z))] = "k"
        edited.append("intro words " + "".join(z) + " and more")
    found = decontaminate.search(pa.array([*edited, None, "", BODY]), decontaminate.prepare(list(range(40)), items))
    assert len({(d, i) for d, i, *_ in found} & {(k, k) for k in range(40)}) >= 38       # target recall 0.95
    assert not [f for f in found if f[0] >= 40]
    bench = spark.createDataFrame([(1, BODY[:300]), (2, None), (3, ""), (3, "...")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.hits(docs, bench).collect()} == {1, 2, 3, 10} - ({3} if "other" in BODY[:300].replace("word7", "other") and
                                                                                          BODY[:300].count("word7") * 5 > 30 else set())
    assert decontaminate.hits(docs, bench.limit(0)).count() == 0 and decontaminate.hits(empty, bench).count() == 0
