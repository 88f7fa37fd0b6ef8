"""Spans that the labelers add, by kind; expectation-maximisation against a plain loop over candidates."""

import random
from itertools import product

import pytest

from ledgerlake.llm import pii

LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def planted(rng, kind):
    some = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    name = lambda: some(LETTERS, rng.randint(4, 8)).title()
    return {
        "local phone": f"{some('23456789', 3)}-{some(DIGITS, 3)}-{some(DIGITS, 4)}",
        "key of letters": f"sk_live_{some(LETTERS, 26)}",
        "key": f"ghp_{some(LETTERS + DIGITS, 36)}",
        "local mail": f"{some(LETTERS, 6)}@localhost",
        "name": f"Dr. {name()} {name()}",
        "account": f"account {some('DEFRGB', 2)}{some(DIGITS, 20)}",
        "long key": some(LETTERS, 70) + some(DIGITS, 10),
    }[kind]


KINDS = ("local phone", "key of letters", "key", "local mail", "name", "account", "long key")


def test_recall_by_kind_and_clean_texts(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 9)))
    filler = lambda n: " ".join(word() if rng.random() > 0.06 else rng.choice(["3", "12", "2021", "7.5", "v2", "1st"]) for _ in range(n))
    rows, want = [], {}
    for i in range(420):
        left, right = filler(40), filler(40)
        kind = KINDS[i % len(KINDS)] if i < 140 else None
        put = planted(rng, kind) if kind else ""
        rows.append((i, f"{left} {put} {right}", "x"))
        if kind:
            bare = put.removeprefix("account ")
            start = len(left) + 1 + len(put) - len(bare)
            want[i] = (kind, start, start + len(bare))
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()}
    assert len(got) == 420
    for kind in KINDS:
        mine = [i for i in want if want[i][0] == kind]
        hit = sum(any(s.start < want[i][2] and s.end > want[i][1] for s in [*got[i].added, *got[i].base]) for i in mine)
        assert hit >= 0.9 * len(mine), (kind, hit, len(mine))
    assert sum(bool(got[i].added or got[i].base) for i in range(140, 420)) <= 14        # clean texts are left alone


def test_a_run_of_any_length_is_a_candidate(spark):
    texts = ["a" * 100_000 + "1234567890", "x" * 300_000, "", None, "a" * 100_000 + "1234567890"]
    got = {r.doc_id: r for r in pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [len(got[i].other) for i in range(5)] == [1, 0, 0, 0, 1]
    assert (got[0].other[0].start, got[0].other[0].end) == (0, 100_010)


def test_estimate_against_a_loop_over_candidates():
    """The same steps on every single candidate in place of the counts of patterns."""
    rng = random.Random(3)
    votes = []
    for _ in range(400):
        truth = rng.random() < 0.4
        votes.append(tuple((int(truth) if rng.random() < r else 1 - int(truth)) if rng.random() < 0.8 else 2 for r in (0.9, 0.8, 0.7)))
    counts = {v: votes.count(v) for v in set(votes)}
    share, table = 0.3, {(k, t, v): [[0.15, 0.6, 0.25], [0.6, 0.15, 0.25]][t][v] for k, t, v in product(range(3), range(2), range(3))}
    for _ in range(50):
        post = []
        for v in votes:
            yes, no = share, 1 - share
            for k in range(3):
                yes, no = yes * table[k, 0, v[k]], no * table[k, 1, v[k]]
            post.append(yes / (yes + no))
        share = min(max(sum(post) / len(post), 0.01), 0.99)
        for k, t in product(range(3), range(2)):
            mass = [1 + sum(p if t == 0 else 1 - p for p, v in zip(post, votes) if v[k] == x) for x in range(3)]
            for x in range(3):
                table[k, t, x] = mass[x] / sum(mass)
    got = pii.estimate(counts)
    for v, p in zip(votes, post):
        assert got[v] == pytest.approx(p)
