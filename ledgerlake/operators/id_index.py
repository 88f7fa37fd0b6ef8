"""Duplicate check over the history whose cost follows the batch.

Every run of the store keeps its transaction ids sorted by ``BUCKETS`` hash
buckets, and beside them a split-block Bloom filter: each id sets one bit in each
of the eight words of one block, about ``KEYS`` ids a block. The file statistics
know the buckets of every file. A lookup

1. opens only the filter files of buckets that the batch has ids in, and joins the
   batch's distinct ids with their one block (an equi-join, no scan of ids);
2. opens only the id files of buckets that hold an id which passed the bit test;
3. semi-joins those with the ids that passed, which removes false positives.

A batch of new ids thus reads filters (16 bits an id) and next to no ids; a
single record reads one bucket. Each id is tested against every live run, so
compaction, which keeps the runs few, also keeps lookups cheap. Ids whose label
was replayed since are not counted.

A batch of ``WIDE`` ids has some in every bucket. If the store is no larger than
the tests of the batch's ids against every run would be, its ids are joined with
the stored ids at once: each id then moves once, not once for every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, KEYS, WORDS = 4096, 32, 8
WIDE = 32 * BUCKETS
ROWS_A_FILE = 500_000
STORED = "external_transaction_id"


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _block(h: Column, blocks: Column) -> Column:
    return F.pmod(F.shiftright(h, 8), blocks)


def _bits(id_col: Column) -> list[Column]:
    """The bit an id has in each word of its block."""
    g = F.xxhash64(id_col, F.lit("bits"))
    return [F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int").alias(f"b{i}") for i in range(WORDS)]


def blocks_for(n: int) -> int:
    """Blocks in each bucket for a run of n ids."""
    return max(1, -(-n // (BUCKETS * KEYS)))


def index_rows(rows: DataFrame, n: int) -> DataFrame:
    """Ids of a run of n rows by bucket, ready to be written; a small run is one file."""
    keep = [c for c in ("ingest_batch",) if c in rows.columns]
    ids = rows.select(STORED, *keep, _bucket(F.xxhash64(STORED)).alias("bucket"))
    # buckets are even by their hash: ranges of them need no sample of the rows
    files = max(1, -(-n // ROWS_A_FILE))
    return (ids.repartitionById(files, (F.col("bucket") * F.lit(files) / BUCKETS).cast("int"))
            .sortWithinPartitions("bucket", STORED))


def filter_rows(rows: DataFrame, blocks: int) -> DataFrame:
    """One row a block: its eight words. Bits are combined before the shuffle: from rows that
    lie by bucket, as ``index_rows`` writes them, hardly more than a row a block is moved."""
    h = F.xxhash64(STORED)
    bit = rows.where(F.col(STORED).isNotNull()).select(
        _bucket(h).alias("bucket"), _block(h, F.lit(blocks)).alias("block"), *_bits(F.col(STORED)))
    words = [F.expr(f"bit_or(shiftleft(1L, b{i}))").alias(f"w{i}") for i in range(WORDS)]
    return (bit.groupBy("bucket", "block").agg(*words).withColumn("ingest_batch", F.lit(None).cast("string"))
            .repartitionByRange("bucket", "block").sortWithinPartitions("bucket", "block"))


def _files(snap, table: str, buckets: DataFrame, runs: list[str]) -> list[str]:
    """Files of a table that may hold rows of (run, bucket)."""
    span = (snap.read("files").where((F.col("table") == table) & F.col("run").isin(runs))
            .select("file", "run", F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))).alias("bucket")))
    return [r.file for r in span.join(buckets, [c for c in ("run", "bucket") if c in buckets.columns]).select("file").distinct().collect()]


def stored_ids(ids: DataFrame, id_col: str, snap, exclude_batch: str | None = None) -> DataFrame:
    """Distinct ids of the batch that some live label stores, in column ``external_transaction_id``."""
    from ..session import scratch_path

    spark = ids.sparkSession
    live = sorted(snap.runs(exclude_batch))
    empty = spark.createDataFrame([], f"{STORED} string")
    if not live:
        return empty
    # the batch's ids are used twice; only file names reach the driver
    staged, passed = scratch_path(spark, "lookup"), scratch_path(spark, "candidates")
    ids.select(F.col(id_col).alias(STORED)).where(F.col(STORED).isNotNull()).distinct() \
        .withColumn("h", F.xxhash64(STORED)).withColumn("bucket", _bucket(F.col("h"))).write.parquet(staged)
    want = spark.read.schema(f"{STORED} string, h bigint, bucket int").parquet(staged)
    asked = want.count()
    if asked >= WIDE:
        held = (snap.read("files").where((F.col("table") == "ids") & F.col("run").isin(live))
                .agg(F.coalesce(F.sum("file_rows"), F.lit(0))).first()[0])
        if held <= asked * (2 * len(live) - 1):
            return snap.read("ids", exclude_batch).join(want, STORED, "left_semi").select(STORED).distinct()
    files = _files(snap, "id_filters", want.select("bucket").distinct(), live)
    if not files:
        return empty
    runs = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(snap.blocks[r]).cast("bigint").alias("blocks")) for r in live])
    probe = (want.select(STORED, "bucket", "h", F.explode(runs).alias("r"))
             .select(STORED, "bucket", F.col("r.run").alias("run"), _block(F.col("h"), F.col("r.blocks")).alias("block")))
    block = snap.read("id_filters", exclude_batch, files=files).drop("ingest_batch")
    test = " AND ".join(f"getbit(w{i}, b{i}) = 1" for i in range(WORDS))
    # the bits follow from the id: they need not travel
    met = probe.join(block, ["run", "bucket", "block"]).select("*", *_bits(F.col(STORED)))
    met.where(test).select(STORED, "run", "bucket").write.parquet(passed)
    maybe = spark.read.schema(f"{STORED} string, run string, bucket int").parquet(passed)
    files = _files(snap, "ids", maybe.select("run", "bucket").distinct(), live)
    if not files:
        return empty
    return (snap.read("ids", exclude_batch, files=files)
            .join(maybe, [STORED, "run", "bucket"], "left_semi").select(STORED).distinct())
