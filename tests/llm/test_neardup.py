"""Near-duplicates that bands, hubs and sorted neighbours alone do not find."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.llm import neardup


def test_the_search_of_open_buckets_is_whole(spark, monkeypatch):
    """Among texts of one bucket no pair that reaches the threshold is left out, and alike ones below it give few pairs."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    form, texts = np.arange(10**6, 10**6 + 72), []
    for k in range(300):                                   # a family at 0.6, every tenth with a partner
        own = rng.integers(0, 10**6, 24)
        texts.append((np.concatenate([own, form]), rng.integers(1, 6, 96) if k % 3 == 0 else np.ones(96, int)))
        if k % 10 == 0:
            texts.append((np.concatenate([rng.integers(0, 10**6, k % 12), own[k % 12:], form]), texts[-1][1]))
        if k % 10 == 1:                                    # the same set, one shingle much heavier
            texts.append((texts[-1][0], np.where(np.arange(96) == 5, 200, 1)))
    rows = []
    for k, (x, w) in enumerate(texts):
        x, at = np.unique(x.astype(np.uint32), return_index=True)
        w = w[at].astype(np.uint32)
        texts[k] = x, w
        rows.append((k.to_bytes(2, "big"), x.tobytes(), b"" if (w == 1).all() else w.tobytes()))
    sets = spark.createDataFrame(rows, "node binary, ids binary, weights binary").repartition(4)
    live = sets.select("node", F.col("node").alias("comp"), F.lit(1).alias("bucket"))
    got = [tuple(int.from_bytes(v, "big") for v in r) for r in neardup.remaining(live, sets, 0.8).collect()]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if neardup.similarity(*texts[i], *texts[j]) >= 0.8}
    assert len(want) >= 50 and want <= set(got) and len(got) == len(set(got))
    plain = [k for k, (_, w) in enumerate(texts) if w.max() == 1]
    assert len([p for p in got if p[0] in plain and p[1] in plain]) < len(plain) ** 2 / 20


def test_repeated_lines(spark):
    """A text and its copy with one line said fifty times: set Jaccard 0.96, probability Jaccard 0.21."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(20):
        w = [f"w{x}" for x in rng.integers(0, 1 << 40, 100)]
        rows += [(k, " ".join(w)), (k + 100, " ".join(w[:50] + w[40:50] * 49 + w[50:])), (k + 200, " ".join(w[:50] + w[40:50] * 20 + w[50:]))]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 100 for i, _ in rows}
