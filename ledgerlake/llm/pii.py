"""Personal data by weak supervision, in DataFrame functions only.

**Base spans** (email, ip, card, phone) are regular expressions with checks;
offsets count code points. Possessive quantifiers match what the plain ones do
without their recursion, so a text of one endless run is no problem.

**The method** adds spans of kind ``other``. Candidates are what any labeler can
vote for and no base span overlaps: runs of word and address characters with a
digit or @, local phone numbers, key prefixes and titles with names. Three
labelers vote yes, no or abstain on each: a *regex* labeler (shape), a
*gazetteer* labeler (mail providers, key prefixes, titles) and a *context* labeler
(the word before). Their votes are counted per pattern over all documents; the
27 counts are all that expectation-maximisation needs to estimate the labelers'
reliabilities. The posterior of each pattern then trains the final classifier,
a naive Bayes model over span features and the first two votes, from counts per feature value and
pattern. Only these tables of fixed size reach the driver.

Defined results: null and empty texts have no spans; without candidates the
model adds none; rows are searched one by one and repeated rows repeat.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import stage, table

BASE = ("email", "ip", "card", "phone")
RULES = {
    # a local part begins where a run begins or where the last match ended
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TITLES = "(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Herr|Frau|Mme)\\.?\\x20"
KEYS = "(?:sk|pk|ghp|gho|xox[abp])[_-]"
LOCAL = "\\(?[0-9]{3}\\)?[\\x20.-][0-9]{3}[\\x20.-][0-9]{4}"
RUN = "[A-Za-z0-9+@._/=%-]"
#: Local phone numbers, titles with names, key prefixes, and runs with a digit or @.
CANDIDATE = (f"(?<!{RUN})(?:{LOCAL}(?![A-Za-z0-9])|{TITLES}[A-Z][A-Za-z'-]++(?:\\x20[A-Z][A-Za-z'-]++)?"
             f"|{KEYS}[A-Za-z0-9_-]{{16}}{RUN}*+|[A-Za-z+._/=%-]*+[0-9@]{RUN}*+)")
PROVIDERS = "(?i)@[A-Za-z0-9.-]*(mail|example|yahoo|outlook|proton|icloud)"
PREFIXES = "^(sk|pk|ghp|gho|xox[abp]|AKIA|ASIA|AIza|eyJ)[A-Za-z0-9_-]{8,}"
CUES = ("token", "key", "apikey", "password", "passwd", "secret", "phone", "tel", "mobile", "fax", "mail", "email",
        "contact", "card", "account", "iban", "ssn", "passport", "id")
FEATURES = ("size", "digits", "marks", "at", "cue", "shape", "listed")
BINS = 6


def _digits(x):
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits):
    at = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(F.filter(at, lambda x: x.isNotNull()), F.lit(0), lambda t, x: t + x) % 10 == 0


def _valid(kind: str, m):
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, "\\."), lambda p: (F.length(bare(p)) <= 3)
                        & (F.concat(F.lit("0"), F.substring(bare(p), 1, 3)).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda s: _valid(kind, s["text"])


def _is(order: int):
    return lambda s: s["kind"] == order


def _placed(found, rest, order: int, name: str):
    """Spans (start, order, end, text, before) from the matches and the pieces between them."""
    lengths = F.transform(found, lambda m, i: F.struct(F.length(F.get(rest, i)).alias("gap"), F.length(m).alias("n")))
    none = F.array().cast("array<struct<start:int,n:int>>")
    run = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda t, x: F.struct(
        (t["at"] + x["gap"] + x["n"]).alias("at"),
        F.concat(t["out"], F.array(F.struct((t["at"] + x["gap"]).alias("start"), x["n"].alias("n")))).alias("out")))["out"]
    return F.transform(run, lambda s, i: F.struct(
        s["start"].alias("start"), F.lit(order).alias("kind"), (s["start"] + s["n"]).alias("end"), F.get(found, i).alias("text"),
        F.lower(F.regexp_extract(F.right(F.get(rest, i), F.lit(40)), "([A-Za-z]+)[^A-Za-z0-9]*$", 1)).alias("before")))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (sorted spans) and candidates."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    found = [F.when(F.col("text").contains(NEEDS[k]) if NEEDS[k] else F.lit(True), F.regexp_extract_all("text", F.lit(RULES[k]), F.lit(0)))
             .otherwise(none).alias(f"m_{k}") for k in BASE]
    d = d.select("doc_id", "text", *found, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("m_other"))
    rules = {**RULES, "other": CANDIDATE}
    rest = [F.when(F.size(f"m_{k}") > 0, F.split("text", rules[k], -1)).alias(f"r_{k}") for k in rules]
    d = d.select("doc_id", *[f"m_{k}" for k in rules], *rest)
    d = d.select("doc_id", *[F.when(F.size(f"m_{k}") > 0, _placed(F.col(f"m_{k}"), F.col(f"r_{k}"), i, k)).alias(k) for i, k in enumerate(rules)])
    empty = F.array().cast(d.schema["other"].dataType)
    d = d.select("doc_id", "other", F.array_sort(F.concat(*[
        F.coalesce(F.filter(k, _check(k)), empty) for k in BASE])).alias("base"))
    free = F.filter("other", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))
    return d.select("doc_id", "base", F.coalesce(free, empty).alias("other"))


def votes(text, before):
    """Votes of the regex, gazetteer and context labelers: 1 yes, 0 no, 2 abstain."""
    n = F.length(_digits(text))
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    shape = F.when(text.rlike("[A-Za-z0-9]@[A-Za-z0-9]") | (n >= 8) | ((n >= 3) & (letters >= 3) & (F.length(text) >= 12)), 1)
    # a candidate without a digit or @ is there for a title or prefix: the shape says nothing
    shape = shape.when((n >= 1) & (n <= 3) & ~text.contains("@"), 0).otherwise(2)
    names = F.when(text.rlike(PROVIDERS) | text.rlike(PREFIXES) | text.rlike("^" + TITLES), 1).otherwise(2)
    cue = F.when(before.isin(*CUES), 1).when(before == "", 2).otherwise(0)
    return shape, names, cue


def features(text, before):
    """A bin of 0..BINS-1 for each of FEATURES."""
    cap = lambda x: F.least(x, F.lit(BINS - 1)).cast("int")
    size = F.length(text)
    return [cap(F.floor(F.log2(size))), cap(F.floor(F.length(_digits(text)) * 5 / size)),
            cap(F.length(F.regexp_replace(text, "[A-Za-z0-9]", ""))), F.when(text.rlike("[A-Za-z0-9]@[A-Za-z0-9]"), 1).otherwise(0),
            F.when(before.isin(*CUES), 2).when(before == "", 1).otherwise(0), *votes(text, before)[:2]]


def estimate(counts: dict[tuple[int, int, int], int], rounds: int = 50) -> dict[tuple[int, int, int], float]:
    """Posterior that a candidate is personal data for each pattern of votes.

    Labelers are independent given the truth; a step re-estimates how often each
    gives each vote. Starts from the belief that a yes vote is right four times in five.
    """
    share = 0.3
    table_ = [[[0.15, 0.6, 0.25], [0.6, 0.15, 0.25]] for _ in range(3)]      # labeler, truth (yes, no), vote (no, yes, abstain)
    post: dict = {}
    for _ in range(rounds):
        for v in counts:
            yes, no = share, 1 - share
            for k in range(3):
                yes, no = yes * table_[k][0][v[k]], no * table_[k][1][v[k]]
            post[v] = yes / (yes + no)
        total = sum(counts.values())
        mass = sum(n * post[v] for v, n in counts.items())
        share = min(max(mass / total, 0.01), 0.99)
        for k in range(3):
            for truth in (0, 1):
                w = [1.0, 1.0, 1.0]
                for v, n in counts.items():
                    w[v[k]] += n * (post[v] if truth == 0 else 1 - post[v])
                table_[k][truth] = [x / sum(w) for x in w]
    return post


def train(candidates: DataFrame) -> tuple[float, list[list[float]]] | None:
    """Log odds of the class and of each feature value; ``candidates`` has text and before."""
    f = features(F.col("text"), F.col("before"))
    v = votes(F.col("text"), F.col("before"))
    rows = candidates.select(F.array(*[x.cast("int") for x in v]).alias("v"), F.posexplode(F.array(*f)).alias("f", "bin"))
    got = rows.groupBy("v", "f", "bin").agg(F.count("*").alias("n")).collect()          # at most 27 x 7 x 6 rows
    counts: dict = {}
    for r in got:
        if r["f"] == 0:
            counts[tuple(r["v"])] = counts.get(tuple(r["v"]), 0) + r["n"]
    if not counts:
        return None
    post = estimate(counts)
    yes, no = sum(n * post[v] for v, n in counts.items()) + 1, sum(n * (1 - post[v]) for v, n in counts.items()) + 1
    table_ = [[[1.0, 1.0] for _ in range(BINS)] for _ in FEATURES]
    for r in got:
        p = post[tuple(r["v"])]
        table_[r["f"]][r["bin"]][0] += r["n"] * p
        table_[r["f"]][r["bin"]][1] += r["n"] * (1 - p)
    odds = [[math.log(a / (yes + BINS)) - math.log(b / (no + BINS)) for a, b in bins] for bins in table_]
    return math.log(yes / no), odds


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and the spans that the method adds."""
    s = stage(spans(docs), "spans")
    model = train(s.select(F.explode("other").alias("c")).select("c.text", "c.before"))
    if model is None:
        return s.withColumn("added", F.col("other"))
    prior, odds = model

    def score(c):
        f = features(c["text"], c["before"])
        return sum((F.get(F.array(*map(F.lit, odds[i])), f[i]) for i in range(len(FEATURES))), F.lit(prior))

    return s.select("doc_id", "base", F.filter("other", lambda c: score(c) > 0).alias("added"))


def _written(spans_):
    names = F.array(*map(F.lit, [*BASE, "other"]))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find(table(spark, sf_dir, "documents"))
    count = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return d.select("doc_id", *count, F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
                    _written(F.array_sort(F.concat("base", "added"))).alias("spans"))
