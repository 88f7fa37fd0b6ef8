"""Quality rules with a distribution test, in DataFrame functions only.

Base rules count words, repeated lines, repeated three-word windows and marks.
The method compares two histograms of a document, its character classes and its
common words, with those of all documents of its language by Jensen-Shannon
distance (base 2, 0 to 1). A histogram of fewer than ``MIN_CHARS`` characters
or ``MIN_WORDS`` words says nothing and passes (the minimum-length guard).

Defined results: a null or empty text has no words, so it fails the base rule;
null languages form one language of their own. Rows are judged one by one;
repeated rows repeat. A language without a character passes every guard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import stage, table, word_array

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Character classes by their members; what is in none is the last class.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
CLASSES = (LETTERS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", SPACES, ".,;:!?'\"()-", SYMBOLS)
#: Frequent function words of the languages; what is none of them is the last bin.
COMMON = ("the", "of", "and", "to", "in", "that", "is", "der", "die", "und", "das", "von", "zu", "den",
          "de", "la", "le", "et", "les", "des", "en", "que", "el", "los", "se", "por", "un", "a")
MIN_CHARS, MIN_WORDS = 300, 60
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.4


def _without(text, chars: str):
    return F.translate(text, chars, "")


def repeated_words(words):
    """Words that lie in a three-word window found twice or more; ``words`` must be a column."""
    grams = F.when(F.size(words) >= 3, F.array_sort(F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))))
    return grams


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the counts of the base rules, and the two histograms."""
    d = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang"),
                    F.coalesce("text", F.lit("")).alias("text"))
    # the classes are counted in what is left without lower-case letters, a fifth of the text
    d = d.withColumn("words", word_array(F.col("text"))).withColumn("rare", F.regexp_replace("text", "[a-z]+", ""))
    d = d.withColumn("grams", repeated_words(F.col("words")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    g = F.col("grams")
    again = F.array_sort(F.transform(F.filter(
        F.transform(g, lambda x, k: F.struct(
            x["i"].alias("i"), (F.coalesce(F.get(g, k - 1)["h"] == x["h"], F.lit(False))
                                | F.coalesce(F.get(g, k + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
        lambda x: x["twice"]), lambda x: x["i"]))
    rare = F.length("rare")
    chars = [F.length("text") - rare, *(rare - F.length(_without(F.col("rare"), c)) for c in CLASSES[1:])]
    spread = F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))
    d = d.select("doc_id", "lang", "text", "words", lines.alias("lines"), again.alias("again"),
                 F.array(*chars).alias("chars"), spread.alias("spread"))
    s = F.col("spread")
    common = [F.when(s.contains(f" {w} "), ((F.octet_length(s) - F.octet_length(F.replace(s, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2))
                     .cast("int")).otherwise(0) for w in COMMON]
    a = F.col("again")
    return d.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.get("chars", F.lit(CLASSES.index(SPACES)))).cast("long").alias("word_chars"),
        F.get("chars", F.lit(CLASSES.index(SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(F.transform(a, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1) - x, F.lit(3)))),
                               F.lit(0), lambda t, x: t + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length("text").alias("n_chars"), F.col("chars"), F.array(*common).alias("common"))


def _closed(bins, total):
    """The bins and what is left of the total, as doubles."""
    left = total - F.aggregate(bins, F.lit(0), lambda t, x: t + x)
    return F.transform(F.concat(bins, F.array(left)), lambda x: x.cast("double"))


def js_distance(p, q):
    """Jensen-Shannon distance of two histograms (columns of equal length)."""
    sp, sq = F.aggregate(p, F.lit(0.0), lambda t, x: t + x), F.aggregate(q, F.lit(0.0), lambda t, x: t + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    pq = F.zip_with(F.transform(p, lambda x: x / sp), F.transform(q, lambda x: x / sq),
                    lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.when((sp > 0) & (sq > 0), F.sqrt(F.greatest(F.aggregate(pq, F.lit(0.0), lambda t, x: t + x), F.lit(0.0))))


def judge(docs: DataFrame) -> DataFrame:
    m = measure(docs)
    m = stage(m.select(*[c for c in m.columns if c not in ("chars", "common", "n_chars")], "n_chars",
                       _closed(F.col("chars"), F.col("n_chars")).alias("chars"),
                       _closed(F.col("common"), F.col("n_words")).alias("common")), "measured")
    add = lambda c, n: F.array(*[F.sum(F.get(F.col(c), F.lit(i))) for i in range(n)])
    ref = m.groupBy("lang").agg(add("chars", len(CLASSES) + 1).alias("ref_chars"), add("common", len(COMMON) + 1).alias("ref_common"))
    d = m.join(ref, "lang")
    char_js, word_js = js_distance(F.col("chars"), F.col("ref_chars")), js_distance(F.col("common"), F.col("ref_common"))
    d = d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
                 F.when(F.col("n_chars") >= MIN_CHARS, char_js).alias("char_distance"),
                 F.when(F.col("n_words") >= MIN_WORDS, word_js).alias("word_distance"))
    near = (F.coalesce(F.col("char_distance"), F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & near).alias("kept"), "char_distance", "word_distance")


def op7_js_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
