"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled
by class log-count ratios.

* **Indicators.** The grams are unigrams and bigrams of byte classes (one class
  for lower-case, upper-case, digits, white space, non-ASCII and one for each
  ASCII mark) and three word grams (a word equal to the one before, a word
  pair seen earlier in the text, any word). A gram yields one indicator for
  each level ``share >= 2**-l`` that its share of the text reaches, so long
  texts do not switch every indicator on.
* **Log-count ratios** come from all labelled training rows: the counts per
  class are summed by Spark; the table has a fixed number of features.
* **Linear model.** Dual coordinate descent on the scaled indicators of at
  most ``per_class`` rows of each class (the rows with the smallest id hash;
  the documented bound of the driver's share of the work), then a logistic
  curve over the margin with the class shares of all training rows.

Defined results: a null text is the empty text, which has no indicators and
gets the score of the intercept; a null doc_id is the empty id. Repeated label
rows of a document count once, with the smallest quality; null labels are
ignored. Without two classes to learn from every score is the share of class 1
(1 if there are no labels at all). Rows repeat in the output as in the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import SPACE_WORDS, Chunk, chunks, words
from .stage import drop, stage, table

THRESHOLD = 0.3
LEVELS = 8               # shares 1/2, 1/8, 1/32, ... (one indicator for each factor of 4)
PART, PART_DOCS = 1 << 18, 256           # bytes and documents counted at once: some 100 bytes of work for each, 50 KB for each

CLASS = np.zeros(256, dtype=np.int64)
CLASS[97:123] = 1
CLASS[65:91] = 2
CLASS[48:58] = 3
CLASS[[32, 9, 11, 12, 13]] = 4
CLASS[10] = 5
CLASS[128:] = 6
_marks = [b for b in range(33, 127) if CLASS[b] == 0]
CLASS[_marks] = np.arange(7, 7 + len(_marks))
CLASSES = int(CLASS.max()) + 1
GRAMS = CLASSES + CLASSES * CLASSES + 3
FEATURES = GRAMS * LEVELS


@dataclass(frozen=True)
class Model:
    weight: np.ndarray   # GRAMS x LEVELS, summed over the levels a gram reaches
    bias: float
    slope: float
    offset: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def gram_levels(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram, level) of each gram present; level l: share >= 4**-l / 2."""
    n = len(c)
    cls = CLASS[c.buf]
    doc = np.repeat(np.arange(n), c.size)
    one = np.bincount(doc * CLASSES + cls, minlength=n * CLASSES).reshape(n, CLASSES)
    same = doc[1:] == doc[:-1]
    pair = (doc[1:] * CLASSES + cls[:-1]) * CLASSES + cls[1:]
    two = np.bincount(pair[same], minlength=n * CLASSES * CLASSES).reshape(n, CLASSES * CLASSES)
    w = words(c, SPACE_WORDS, lower=False)
    wd = w.doc
    inner = wd[1:] == wd[:-1] if len(wd) else np.zeros(0, bool)
    again = (w.hash[1:] == w.hash[:-1]) & inner
    pairs = (w.hash[1:] * np.uint64(31) + w.hash[:-1])[inner]
    at = wd[1:][inner]
    order = np.lexsort((pairs, at))
    seen = np.zeros(len(order), bool)
    seen[1:] = (pairs[order][1:] == pairs[order][:-1]) & (at[order][1:] == at[order][:-1])
    count = np.maximum(w.count, 1)
    word = np.stack([np.bincount(wd[1:][again], minlength=n), np.bincount(at[order][seen], minlength=n), w.count], 1)
    share = np.concatenate([np.concatenate([one, two], 1) / np.maximum(c.size, 1)[:, None], word / count[:, None]], 1)
    d, g = np.nonzero(share)
    level = np.clip(np.floor(-np.log2(share[d, g]) / 2), 0, LEVELS - 1).astype(np.int64)
    return d, g, level


def indicators(d: np.ndarray, g: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every indicator: a gram's level and all coarser ones."""
    reach = LEVELS - level
    rep = np.repeat(np.arange(len(g)), reach)
    step = np.arange(len(rep)) - np.repeat(np.cumsum(reach) - reach, reach)
    return d[rep], g[rep] * LEVELS + level[rep] + step


def _codes(batches):
    """Per document: its grams with their finest level, two bytes each."""
    for b in batches:
        for c in chunks(b.column("text"), PART, PART_DOCS):
            d, g, level = gram_levels(c)
            code = (g * LEVELS + level).astype(np.uint16)
            off = np.searchsorted(d, np.arange(len(c) + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")[c.first:c.first + len(c)],
                 pa.array([code[i:j].tobytes() for i, j in zip(off, off[1:])], pa.binary())], ["doc_id", "codes"])


def expand(codes: bytes) -> np.ndarray:
    """All indicators of a document from its codes."""
    code = np.frombuffer(codes, np.uint16).astype(np.int64)
    return indicators(code, code // LEVELS, code % LEVELS)[1]


def _class_counts(batches):
    """Indicator counts per class, one row for each feature and task."""
    total = np.zeros((2, FEATURES), dtype=np.int64)
    for b in batches:
        for label, codes in zip(b.column("label").to_pylist(), b.column("codes").to_pylist()):
            total[label, expand(codes)] += 1
    cl, f = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cl.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(total[cl, f])],
                                     ["label", "feature", "n"])


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int) -> np.ndarray:
    """Dual coordinate descent for the L1-loss linear SVM; the last weight is the bias."""
    w = np.zeros(len(ratio) + 1)
    feats = [np.append(r, len(ratio)) for r in rows]
    vals = [np.append(ratio[r], 1.0) for r in rows]
    diag = np.array([v @ v for v in vals])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            grad = y[i] * (w[feats[i]] @ vals[i]) - 1.0
            new = min(max(alpha[i] - grad / diag[i], 0.0), cost)
            if new != alpha[i]:
                w[feats[i]] += (new - alpha[i]) * y[i] * vals[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic curve over the margin by Newton steps, rows weighted."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, 1 - 1e-3, 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = weight * (p - t)
        h = weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([g @ margin + 1e-3 * a, g.sum()])
        hess = np.array([[h @ (margin * margin) + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows as (label, codes, pick). Texts stay where they are read: only
    their codes, about an eighth of the bytes, meet the labels."""
    one = (labels.select("doc_id", F.col("quality").cast("int").alias("q")).where("q in (0, 1)")
           .groupBy("doc_id").agg(F.min("q").alias("label")).where(~held_out()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = docs.select("doc_id", "text").where(~held_out()).mapInArrow(_codes, f"doc_id {kind}, codes binary")
    return coded.join(one, "doc_id").select("label", "codes", F.xxhash64("doc_id").alias("pick"))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 2500, cost: float = 1.0,
        epochs: int = 60, smooth: float = 1.0, seed: int = 11) -> Model:
    train = stage(labelled(docs, labels), "labelled")
    counts = (train.mapInArrow(_class_counts, "label int, feature int, n long")
              .groupBy("label", "feature").agg(F.sum("n").alias("n")).toPandas())
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        drop(train)
        share = min(max(float(next(iter(sizes), 1)), 1e-6), 1 - 1e-6)
        return Model(np.zeros((GRAMS, LEVELS)), 0.0, 1.0, float(np.log(share / (1 - share))))
    c = np.full((2, FEATURES), smooth)
    np.add.at(c, (counts["label"].to_numpy(), counts["feature"].to_numpy()), counts["n"].to_numpy())
    ratio = np.log(c[1] / c[1].sum()) - np.log(c[0] / c[0].sum())
    rows, y = [], []
    for cl in (0, 1):
        got = train.where(F.col("label") == cl).orderBy("pick", "codes").limit(per_class).toArrow()
        rows += [expand(x) for x in got.column("codes").to_pylist()]
        y += [1.0 if cl else -1.0] * got.num_rows
    y = np.array(y)
    w = descend(rows, y, ratio, cost, epochs, seed)
    weight = (w[:-1] * ratio).reshape(GRAMS, LEVELS)
    margin = np.array([weight.ravel()[r].sum() for r in rows]) + w[-1]
    drop(train)
    share = np.where(y > 0, sizes[1] / (y > 0).sum(), sizes[0] / (y < 0).sum())
    slope, offset = platt(margin, y, share / share.sum() * len(y))
    reached = np.flip(np.cumsum(np.flip(weight, 1), 1), 1)
    return Model(reached, float(w[-1]), float(slope), float(offset))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row, with the score of its text."""
    cast = [f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]

    def run(batches):
        for b in batches:
            out = np.empty(b.num_rows)
            for c in chunks(b.column("text"), PART, PART_DOCS):
                d, g, level = gram_levels(c)
                margin = np.bincount(d, weights=model.weight[g, level], minlength=len(c)) + model.bias
                out[c.first:c.first + len(c)] = model.score(margin)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(out)], [*keep, "score"])

    sent = dict.fromkeys([*keep, "text"])            # the text goes to Python once
    return docs.select(*sent).mapInArrow(run, ", ".join([*cast, "score double"]))


def op3_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return (score(docs, model, ["doc_id"])
            .select("doc_id", held_out().alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, cols).where(F.col("score") >= THRESHOLD).select(*cols)
