"""Benchmark items in edited and unspaced texts."""

import numpy as np
import pyarrow as pa

from ledgerlake.llm import decontaminate


def test_a_tenth_of_the_bytes_edited():
    """No word of ten letters or more stays whole when every eleventh byte is another one."""
    rng = np.random.default_rng(2)
    items = [" ".join("".join(rng.choice(list("abcdefghij"), rng.integers(11, 16))) for _ in range(15)) for _ in range(40)]
    texts = ["intro words " + "".join("z" if k % 11 == 10 else x for k, x in enumerate(t)) + " and more" for t in items]
    found = decontaminate.search(pa.array(texts), decontaminate.prepare(list(range(40)), items))
    assert {(d, i) for d, i, *_ in found} == {(k, k) for k in range(40)}


def test_unspaced_scripts():
    rng = np.random.default_rng(3)
    signs = [chr(0x4E00 + k) for k in range(3000)]
    run = lambda n: "".join(rng.choice(signs, n))
    items = [run(40) for _ in range(30)]
    texts = [run(60) + t + run(60) for t in items] + [run(9) + t[:20] + run(1) + t[21:] + run(9) for t in items] + [run(200)]
    found = decontaminate.search(pa.array(texts), decontaminate.prepare(list(range(30)), items))
    assert {(d, i) for d, i, *_ in found} == {(k, k % 30) for k in range(60)}


def test_item_ids_of_any_type(spark):
    item = "the quick brown fox jumps over a lazy dog again and again"
    docs = spark.createDataFrame([(1, f"so {item} it said"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("q1", item), (None, "something else entirely, of some length"), ("q3", None)], "item_id string, text string")
    found = decontaminate.hits(docs, bench)
    assert dict(found.dtypes)["item_id"] == "string"
    assert [(r.doc_id, r.item_id, r.distance) for r in found.collect()] == [(1, "q1", 0)]


def plain_distance(item, region):
    row = [0] * (len(region) + 1)
    for i, byte in enumerate(item):
        new = [i + 1]
        for j, other in enumerate(region):
            new.append(min(row[j] + (byte != other), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row), row.index(min(row))


def test_edit_distance_equals_the_plain_program():
    rng = np.random.default_rng(4)
    for _ in range(200):
        item, region = bytes(rng.choice(list(b"abc"), rng.integers(1, 20))), bytes(rng.choice(list(b"abcd"), rng.integers(0, 40)))
        want = plain_distance(item, region)
        assert decontaminate.edit_distance(item, region) == want or want[0] == 0
        for most in range(6):
            got = decontaminate.edit_distance(item, region, most)
            assert got[0] == want[0] if want[0] <= most else got[0] > most


def test_recall_by_embedding_and_samples():
    """Windows are found by one piece, so the samples of the walks alone decide; 2, 5 and 10 % of the bytes edited."""
    rng = np.random.default_rng(6)
    letters = list("etaoinshrdlu ")
    items = ["".join(rng.choice(letters, rng.integers(120, 300))) for _ in range(60)]
    held = decontaminate.prepare(list(range(60)), items)
    for share in (0.02, 0.05, 0.1):
        for kind in ("replace", "insert", "lose"):
            texts = []
            for t in items:
                t = list(t)
                for at in sorted(rng.choice(len(t), int(share * len(t)), replace=False))[::-1]:
                    lose = kind == "lose"
                    t[at:at + (kind == "replace" or lose)] = [] if lose else ["#"]
                texts.append("before it " + "".join(t) + " and after it")
            found = {(d, i) for d, i, *_ in decontaminate.search(pa.array(texts), held)}
            assert len(found & {(k, k) for k in range(60)}) >= 54
            assert not found - {(k, k) for k in range(60)}


def test_gaps_and_blocks(spark, monkeypatch):
    """Null and empty texts and items, repeated rows, an empty benchmark, a long text, clashing columns, more than one block."""
    items = [f"item number {k} says that the {w} is somewhere between here and the sea" for k, w in enumerate(("lamp", "road", "bell", "hull"))]
    docs = spark.createDataFrame(
        [(1, items[0], 7), (1, items[0], 7), (2, None, 7), (3, "", 7), (None, "x " + items[2], 7), (5, "word " * 200_000 + items[3], 7)],
        "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(k, t, 0) for k, t in enumerate(items)] + [(9, None, 0), (10, "", 0), (11, " . ", 0), (None, items[0], 0)],
                                  "item_id long, text string, doc_id long")
    assert decontaminate.hits(docs, bench.limit(0)).count() == 0
    assert decontaminate.hits(docs.limit(0), bench).count() == 0
    want = sorted(map(str, [(1, 0), (1, 0), (1, None), (1, None), (None, 2), (5, 3)]))
    for size in (decontaminate.BLOCK_BYTES, 200):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        close = decontaminate.hits(docs, bench, 0.02).collect()
        assert sorted(str((r.doc_id, r.item_id)) for r in close) == want
        assert {r.distance for r in close} == {0}
