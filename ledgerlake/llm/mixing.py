"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources, by code point with null last, weigh 5, 2, 1, repeating, and share
``SHARE`` of all words; a target stops at twice its source's size and the
excess goes to the others by weight. Targets are met in three steps:

1. Every source takes its documents whole as often as its target allows; what
   is left of the target is counted in blocks of ``BLOCK`` words. The blocks of
   all sources are allotted by highest quotients v / (2k + 1).
2. A source's documents lie end to end in shards of about ``SHARD_WORDS`` words
   (by id hash, so a hot source has many); the source's blocks go to its shards
   by highest quotients again, as integer quotas.
3. Each shard takes its quota of blocks with the smallest seeded hash. A
   document's share is what these blocks cover of it.

Quotients are only formed for the seats in doubt: with N seats, total V and k
parties, seats at a quotient of V / (N - k/2) or more are sure and none is won
under V / (N + k/2), which leaves about 2k quotients to rank.

Defined results: null and empty texts have size 0 and are taken 0 times; a
source without words has target 0; a null doc_id is an ordinary value. Equal
rows lie next to each other, and as a set they get the same amounts on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stage import stage, table, text_key, word_array

WEIGHTS = (5, 2, 1)
SHARE, LIMIT = 1.5, 2.0
BLOCK, SHARD_WORDS = 50, 1_000_000
SEED = 2024


def n_words(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: skey, source_size, weight, target. Windows run over sources, not rows."""
    s = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy("skey")
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(every) - 1) % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("most", LIMIT * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "skey")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("level", (SHARE * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                     / F.sum("weight").over(after)).withColumn("rank", F.row_number().over(by_ratio))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))
    return (s.withColumn("cut", F.min(fits).over(whole)["level"])
            .withColumn("target", F.least("most", F.col("cut") * F.col("weight")))
            .select("skey", "source_size", "weight", "target"))


def apportion(parties: DataFrame, group: list[str], party: str) -> DataFrame:
    """Seats of each party: highest v / (2k + 1) win the group's ``n`` seats (ties: by party)."""
    w = Window.partitionBy(*group)
    total, k, n = F.sum("v").over(w), F.count("*").over(w), F.col("n")
    sure = F.when(n > k / 2, F.floor(F.col("v") * (n - k / 2) / total * (1 - 1e-9) + 0.5)).otherwise(0)
    p = parties.withColumn("sure", F.when(total > 0, sure).otherwise(0).cast("long"))
    p = p.withColumn("most", F.when(total > 0, F.floor(F.col("v") * (n + k / 2) / total + 0.5) + 1).otherwise(0).cast("long"))
    p = p.withColumn("left", n - F.sum("sure").over(w))
    doubt = (p.where("v > 0 and most > sure").withColumn("seat", F.explode(F.sequence(F.col("sure") + 1, F.col("most"))))
             .withColumn("q", F.col("v") / (2 * F.col("seat") - 1)))
    order = w.orderBy(F.desc("q"), party)
    won = (doubt.withColumn("r", F.row_number().over(order)).where("r <= left")
           .groupBy(*group, party).agg(F.count("*").alias("more")))
    return (p.join(won, [*group, party], "left")
            .withColumn("seats", F.col("sure") + F.coalesce("more", F.lit(0))).drop("sure", "most", "left", "more"))


def plan(sized: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """``sized`` (skey, size and any columns that make rows) with source_size, target,
    full (whole copies) and cover: the parts (first, n) that chosen blocks cover."""
    ids = [c for c in sized.columns if c not in ("skey", "size")]
    goal = stage(targets(sized), "targets")
    placed = (sized.join(goal, "skey")
              .withColumn("shard", F.pmod(F.xxhash64(*ids), F.ceil(F.col("source_size") / shard_words).cast("long")))
              .withColumn("shard", F.coalesce("shard", F.lit(0))))
    line = Window.partitionBy("skey", "shard").orderBy(*ids, "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = stage(placed.withColumn("first", F.sum("size").over(line) - F.col("size"))
                   .withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")), "placed")
    shard = placed.where("size > 0").groupBy("skey", "shard").agg(F.ceil(F.sum("size") / block).cast("long").alias("blocks"))
    shard = stage(shard, "shards")
    rest = (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")) / block
    wanted = (shard.groupBy("skey").agg(F.sum("blocks").alias("all")).join(goal, "skey").withColumn("v", rest))
    wanted = wanted.withColumn("n", F.round(F.sum("v").over(Window.partitionBy())).cast("long")).withColumn("g", F.lit(0))
    quota = apportion(wanted.select("g", "skey", "all", "v", "n"), ["g"], "skey")
    quota = quota.select("skey", F.least("seats", "all").alias("n"))
    per_shard = stage(apportion(shard.join(quota, "skey").withColumn("v", F.col("blocks").cast("double")), ["skey"], "shard"), "quotas")
    lot = Window.partitionBy("skey", "shard").orderBy(F.xxhash64(F.lit(seed), "skey", "shard", "b"), "b")
    chosen = (per_shard.where("seats > 0").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .withColumn("r", F.row_number().over(lot)).where("r <= seats").select("skey", "shard", "b"))
    parts = (placed.where("size > 0").select("skey", "shard", "first", "size",
             F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))).alias("b"))
             .join(chosen.hint("merge"), ["skey", "shard", "b"]))    # its size isn't known before it is made
    lo = F.greatest(F.col("b") * block, "first")
    hi = F.least((F.col("b") + 1) * block, F.col("first") + F.col("size"))
    cover = (parts.select("skey", "shard", "first", F.struct((lo - F.col("first")).alias("at"), (hi - lo).alias("n")).alias("part"))
             .groupBy("skey", "shard", "first").agg(F.sum("part.n").alias("extra"), F.sort_array(F.collect_list("part")).alias("cover")))
    return (placed.join(cover.withColumn("some", F.lit(True)), ["skey", "shard", "first"], "left")
            .withColumn("some", (F.col("size") > 0) & F.col("some").isNotNull())
            .select(*ids, "size", "source_size", "target", F.when(F.col("size") > 0, F.col("full")).otherwise(0).alias("full"),
                    F.when(F.col("some"), F.col("extra")).otherwise(0).alias("extra"),
                    F.when(F.col("some"), F.col("cover")).alias("cover")))


def source_key():
    """Sorts by code point, null last."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))


def op8_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stage(docs.select("doc_id", source_key().alias("skey"), n_words(F.col("text")).alias("size")), "sized")
    return plan(sized).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"),
                              (F.col("full") * F.col("size") + F.col("extra")).alias("taken"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a whole copy for each full take, and one row with the
    words of the chosen blocks. Rows equal in id, source and text count once."""
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    # one identity for id, source and text; md5 texts have no separator in them
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.withColumn("row", F.unhex(F.md5(F.concat_ws("\n", F.hex(text_key()), mark("doc_id"), mark("source")))))
    sized = stage(rows.select("row", source_key().alias("skey"), n_words(F.col("text")).alias("size"))
                  .groupBy("row").agg(F.first("skey").alias("skey"), F.first("size").alias("size")), "sized")
    take = plan(sized).select("row", "full", "cover").where("full > 0 or cover is not null")
    both = rows.dropDuplicates(["row"]).join(take, "row")
    part = F.array_join(F.flatten(F.transform("cover", lambda p: F.slice(F.col("words"), (p["at"] + 1).cast("int"), p["n"].cast("int")))), " ")
    both = both.withColumn("words", F.when(F.col("cover").isNotNull(), word_array(F.col("text"))))
    copies = F.array_repeat(F.col("text"), F.col("full").cast("int"))
    pieces = F.concat(copies, F.when(F.col("cover").isNotNull(), F.array(part)).otherwise(F.expr("array()").cast("array<string>")))
    return (both.withColumn("piece", F.explode(pieces))
            .select("doc_id", F.col("piece").alias("text"), "lang", "source", F.length("piece").cast("long").alias("n_chars")))
