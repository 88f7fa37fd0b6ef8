"""License notices with edited words; base columns against a plain search."""

import random
import re

from ledgerlake.llm import licenses


def plain_base(text):
    """The base columns of a text, word by word."""
    found = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))]
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(found)) if found[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(found), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def edited(rng, t, how):
    """Template ``t`` with one word replaced, inserted or lost, none of them a name of the license."""
    phrase, _, names = licenses.NOTICES[t]
    out = phrase.split()
    k = rng.choice([k for k in range(1, len(out) - 1) if out[k] not in names.split()])
    if how != "exact":
        out[k:k + (how != "insert")] = {"replace": ["qqq"], "insert": ["qqq"], "lose": []}[how]
    return " ".join(out)


def test_every_template_with_one_edit(spark):
    rng = random.Random(5)
    cases = [(t, how) for t in range(len(licenses.NOTICES)) for how in ("exact", "replace", "insert", "lose") for _ in range(3)]
    docs = spark.createDataFrame([(i, f"Some words, first under the sea. {edited(rng, t, how).title()}; see there.") for i, (t, how) in enumerate(cases)],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, (t, how) in enumerate(cases):
        own = [x for x in got[i].labels.split(",") if x and x not in dict(licenses.BASE).values()]
        assert own == [licenses.NOTICES[t][1]], (cases[i], got[i])
        assert (got[i].score == 1.0) == (how == "exact" or got[i].n_base > 0)


def test_other_names_and_loose_words_are_no_notice(spark):
    texts = ["released under the old license", "licensed under the gnu general public license version 9", "licensed under cc by xx 4 0",
             "under the under the under the " * 2000, "license the under released mit", "permission is hereby given to use the software for any purpose"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = set(dict(licenses.BASE).values())
    assert [set(filter(None, r.labels.split(","))) - base for r in licenses.scan(docs).orderBy("doc_id").collect()] == [set()] * len(texts)


def test_base_columns_against_a_plain_search(spark):
    rng = random.Random(8)
    some = ["cc", "by", "CC", "general", "public", "license", "all", "rights", "Reserved", "x", "é", "1"]
    texts = ["".join(rng.choice(some) + rng.choice([" ", "-", ". ", "\n", ""]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " ", "all rights reserved", "all rights reserved", "cc by " * 50_000, "é" * 100_000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    got = {r.doc_id: r for r in licenses.scan(docs.union(docs.where("doc_id is null"))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(t), t
        assert set(r.base_labels.split(",")) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert licenses.scan(docs.limit(0)).count() == 0
