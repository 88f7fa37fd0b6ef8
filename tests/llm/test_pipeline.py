"""The pipeline, stage by stage, against brute force on the smallest tables."""

import collections
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from ledgerlake.llm import decontaminate, quality
from ledgerlake.llm.stage import stage, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before the first stage and after each one."""
    docs = table(spark, SF, "documents")
    out = [docs.collect()]
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        docs = stage(step(spark, docs, SF), f"test-{k}")
        out.append(docs.collect())
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_stage(spark, steps):
    docs = table(spark, SF, "documents")
    score = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, table(spark, SF, "labels")), ["doc_id"]).collect()}
    assert {r.doc_id for r in steps[1]} == {i for i, s in score.items() if s >= quality.THRESHOLD}
    label = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in steps[1]}
    good, bad = ([i for i in score if label.get(i) == k] for k in (1, 0))
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)
    assert set(steps[1]) <= set(steps[0])


def test_dedup_stage(steps):
    sets = []
    for r in steps[1]:
        w = [x.lower() for x in words(r.text)]
        sets.append(collections.Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else {})
    group = list(range(len(sets)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    def probability_jaccard(x, y):
        both = x.keys() & y.keys()
        return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys()) for d in both)

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            n = len(x.keys() & y.keys())
            same = (steps[1][i].text or "") == (steps[1][j].text or "")
            if same or n and (n >= 0.8 * (len(x) + len(y) - n) or 2 * n >= max(len(x), len(y)) and probability_jaccard(x, y) >= 0.8):
                group[top(i)] = top(j)
    first = {}
    for i, r in enumerate(steps[1]):
        first[top(i)] = min(first.get(top(i), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in steps[2]) == sorted(first.values())
    assert set(steps[2]) <= set(steps[1]) and len(first) < len(sets)


def test_decontamination_stage(spark, steps):
    gap = b"\x01" * 64                       # no match within a tenth of an item reaches over it
    texts = [(r.text or "").lower().encode() for r in steps[2]]
    flat = np.frombuffer(b"".join(t + gap for t in texts), np.uint8)
    ends = np.cumsum([len(t) + len(gap) for t in texts])
    at, dirty = np.arange(len(flat) + 1, dtype=np.int32), set()
    for r in table(spark, SF, "benchmark").collect():
        item = (r.text or "").lower().encode()
        row = np.zeros(len(flat) + 1, np.int32)
        for k, byte in enumerate(item, 1):
            step = row + 1
            np.minimum(step[1:], row[:-1] + (flat != byte), out=step[1:])
            step[0] = k
            row = np.minimum.accumulate(step - at) + at
        found = np.flatnonzero(row <= decontaminate.SHARE * len(item)) - 1 if item else []
        dirty |= {steps[2][d].doc_id for d in np.searchsorted(ends, found, "right")}
    assert {r.doc_id for r in steps[2]} - {r.doc_id for r in steps[3]} == dirty
    assert set(steps[3]) <= set(steps[2])


def test_mix_stage(steps):
    size, source, text = {}, {}, {}
    for r in steps[3]:
        size[r.doc_id], source[r.doc_id], text[r.doc_id] = len(words(r.text)), r.source, r.text
    order = sorted(set(source.values()), key=lambda s: (s is None, s))
    whole = {s: sum(size[i] for i in size if source[i] == s) for s in order}
    left, total, target = dict(zip(order, [(5, 2, 1)[k % 3] for k in range(len(order))])), 1.5 * sum(whole.values()), {}
    while left:
        share = {s: total * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > 2 * whole[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * whole[s]
            total -= target[s]
            del left[s]
    taken = collections.Counter()
    for r in steps[4]:
        taken[r.doc_id] += len(words(r.text))
        assert r.text == text[r.doc_id] or not collections.Counter(words(r.text)) - collections.Counter(words(text[r.doc_id]))
    assert all(n <= 2 * size[i] for i, n in taken.items())
    for s in order:
        assert sum(n for i, n in taken.items() if source[i] == s) == pytest.approx(target[s], rel=0.02, abs=20)


def test_token_stage(steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in steps[4]:
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = sorted(steps[5], key=lambda r: r.start)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
