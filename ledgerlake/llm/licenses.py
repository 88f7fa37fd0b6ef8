"""License scans by diagonal voting.

Every rolling word pair of every text is joined to the places where the
templates have the same pair. A hit at text word p and template word t votes
for the diagonal p - t: an unbroken copy puts all its votes on one diagonal, an
inserted or lost word moves the rest to a neighbouring one. Votes are summed
per (text, template, diagonal), and each diagonal is merged with its neighbours
up to as many steps away as the template may take word edits. An edit spoils two
pairs at most, so a copy leaves at least ``size - 2 * edits`` pairs on its
merged diagonals; those that have them are verified by the smallest word edit
distance between the template and any piece of the text at the diagonal.

A template of m words may take ``max(1, m // SHARE)`` replaced, inserted or lost
words, but not those that name the license (its third field): a notice of one
license with another name in it is none of the first.

Base phrases are templates too: a place is a diagonal with all their pairs.

Defined results: null and empty texts have no words and no labels; equal rows
are scanned each on its own; columns besides doc_id and text are ignored. The
templates are a fixed list, so broadcasting their pairs is bounded; texts meet
them in one map-side join. A pair carries the words around it, as numbers in
the templates' vocabulary, so that verification needs no second look at the text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window

from .arrays import NAME_WORDS, chunks, mix, words
from .decontaminate import edit_distance
from .stage import table

#: Phrases of the base rule, and short notices of common licenses.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
NOTICES = (
    ("released under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", ""),
    ("licensed under the apache license version 2 0", "apache-2.0", "apache 2"),
    ("licensed under the gnu general public license version 3", "gpl-3.0", "general public 3"),
    ("licensed under the gnu general public license version 2", "gpl-2.0", "general public 2"),
    ("gnu lesser general public license", "lgpl", "lesser"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", "cc nc 4"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", "cc sa 4"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ""),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0", "mozilla"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", ""),
)
SHARE = 6                                  # words of a template for each edit it may take
PHRASES = [p.split() for p, *_ in [*BASE, *NOTICES]]
LABELS = [x[1] for x in [*BASE, *NOTICES]]
EDITS = [0] * len(BASE) + [max(1, len(p) // SHARE) for p in PHRASES[len(BASE):]]
#: A word's number is its place here and one more; 0 stands for every other word and for none.
VOCABULARY = sorted({w for p in PHRASES for w in p})
REACH = max(len(p) + d for p, d in zip(PHRASES, EDITS))


def pair_hashes(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]).view(np.int64)


def word_hashes(text: str) -> np.ndarray:
    (c,) = chunks(pa.array([text]))
    return words(c, NAME_WORDS).hash


def template_rows() -> list[tuple[int, ...]]:
    """(pair hash, template, word, number of pairs, bit of the pair, words, edits)."""
    out = []
    for t, phrase in enumerate(PHRASES):
        h = pair_hashes(word_hashes(" ".join(phrase)))
        out += [(int(x), t, i, len(h), 1 << i, len(phrase), EDITS[t]) for i, x in enumerate(h)]
    return out


def numbered(h: np.ndarray) -> np.ndarray:
    """Vocabulary numbers of words by their hashes."""
    known = word_hashes(" ".join(VOCABULARY))
    order = np.argsort(known)
    at = order[np.minimum(np.searchsorted(known[order], h), len(known) - 1)]
    return np.where(known[at] == h, at + 1, 0).astype(np.uint8)


def _pairs(batches):
    """A row (row, pos, h, around) for every word pair; the first row of a text has no h and holds its id and its
    number of words in pos. ``around`` has the numbers of the REACH words on both sides of the pair's first word;
    it is null where one of the two is in no template, as such a pair hits nothing."""
    for b in batches:
        for c in chunks(b.column("text")):
            w = words(c, NAME_WORDS)
            rid = b.column("row")[c.first:c.first + len(c)]
            yield pa.RecordBatch.from_arrays(
                [rid, b.column("doc_id")[c.first:c.first + len(c)], pa.array(w.count.astype(np.int64)), pa.nulls(len(c), pa.int64()),
                 pa.nulls(len(c), pa.binary())], ["row", "doc_id", "pos", "h", "around"])
            if len(w.hash) < 2:
                continue
            doc, number = w.doc, numbered(w.hash)
            apart = np.arange(len(doc)) + REACH * (doc + 1)          # no text comes within reach of another
            line = np.zeros(len(doc) + REACH * (len(c) + 1), np.uint8)
            line[apart] = number
            at = np.flatnonzero(doc[1:] == doc[:-1])
            some = (number[at] > 0) & (number[at + 1] > 0)
            rows = np.lib.stride_tricks.sliding_window_view(line, 2 * REACH + 1)[apart[at[some]] - REACH]
            offsets = np.concatenate([[0], np.cumsum(some * (2 * REACH + 1))]).astype(np.int32)
            around = pa.Array.from_buffers(pa.binary(), len(at), [
                pa.py_buffer(np.packbits(some, bitorder="little").tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid.to_numpy()[doc[at]]), pa.nulls(len(at), b.column("doc_id").type), pa.array(at - w.first[doc[at]]),
                 pa.array(pair_hashes(w.hash)[at]), around], ["row", "doc_id", "pos", "h", "around"])


def distance(t: int, region: bytes) -> int | None:
    """Word edits between template ``t`` and the closest piece of ``region``; None beyond its edits or without its names."""
    item = bytes(VOCABULARY.index(w) + 1 for w in PHRASES[t])
    d, end = edit_distance(item, region)
    names = [VOCABULARY.index(w) + 1 for w in NOTICES[t - len(BASE)][2].split()]
    piece = region[max(end - len(item) - d, 0):end]
    return d if d <= EDITS[t] and all(x in piece for x in names) else None


@F.pandas_udf(IntegerType())
def _distances(t: pd.Series, region: pd.Series) -> pd.Series:
    known: dict = {}
    out = []
    for key in zip(t, region):
        if key[1] is None:
            out.append(None)
            continue
        if key not in known:
            known[key] = distance(int(key[0]), key[1])
        out.append(known[key])
    return pd.Series(out, dtype="Int32")


def scan(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = (docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
             .mapInArrow(_pairs, f"row long, doc_id {kind}, pos long, h long, around binary"))
    tmpl = spark.createDataFrame(template_rows(), "h long, t int, at int, size int, bit long, words int, edits int")
    hits = (pairs.join(F.broadcast(tmpl), "h", "left").where("t is not null or h is null")
            .groupBy("row", "t", F.when(F.col("t").isNotNull(), F.col("pos") - F.col("at")).alias("diagonal"))
            .agg(F.max("doc_id").alias("doc_id"), F.max(F.when(F.col("t").isNull(), F.col("pos"))).alias("n_words"),
                 F.bit_or("bit").alias("cover"), F.max("size").alias("size"), F.max("words").alias("words"),
                 F.max("edits").alias("edits"), F.min(F.struct("pos", "around")).alias("seen")))
    most = max(EDITS)
    line = Window.partitionBy("row", "t").orderBy("diagonal").rangeBetween(-most, most)
    near = F.collect_list(F.struct("diagonal", "cover")).over(line)           # at most 2 * most + 1 diagonals
    merged = F.aggregate(
        F.filter("near", lambda x: F.abs(x["diagonal"] - F.col("diagonal")) <= F.col("edits")),
        F.lit(0).cast("long"), lambda all_, x: all_.bitwiseOR(x["cover"]))
    is_base = F.col("t") < len(BASE)
    full = is_base & (F.bit_count("cover") == F.col("size"))
    voted = ~is_base & (F.bit_count("merged") >= F.greatest(F.col("size") - 2 * F.col("edits"), F.lit(1)))
    region = F.substring("seen.around", (F.col("diagonal") - F.col("edits") - F.col("seen.pos") + REACH + 1).cast("int"),
                         F.col("words") + 2 * F.col("edits"))
    found = (hits.withColumn("near", near).withColumn("merged", merged)
             .withColumn("full", F.coalesce(full, F.lit(False)))
             .withColumn("edited", _distances("t", F.when(voted, region)))
             .withColumn("good", F.col("edited").isNotNull()))
    label = F.get(F.array(*map(F.lit, LABELS)), F.col("t"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    likeness = F.when(F.col("full"), F.lit(1.0)).when(F.col("good"), 1 - F.col("edited") / F.col("words"))
    return (found.groupBy("row").agg(
                F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
                F.sum(F.col("full").cast("long")).alias("n_base"), F.min(F.when(F.col("full"), F.col("diagonal"))).alias("first_word"),
                F.max(F.when(F.col("full"), F.col("diagonal"))).alias("last_word"), listed(F.when(F.col("full"), label)).alias("base_labels"),
                listed(F.when(F.col("full") | F.col("good"), label)).alias("labels"),
                F.coalesce(F.max(likeness), F.lit(0.0)).alias("score"))
            .drop("row"))


def op9_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
