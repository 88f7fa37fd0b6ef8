"""Input files derived from the test tables, written to the shared scratch folder.

The file sources and the streaming ingest need files to read; these are
written from the (whole) ``raw_transactions`` / ``raw_events`` frames. Each
file holds a range of a split's rows in order, so that per-file row numbers are
well defined and no task writes more than ``ROWS_A_FILE`` rows of a file. A stream
whose results don't depend on the files gets about ``STREAM_ROWS`` rows a file:
it pays for each micro-batch, so its files must not be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import scratch_path

# Column layouts of the three CSV files: natural order, reversed, and one
# without sourceChannel but with an extra column.
LAYOUTS = (
    list(C.INPUT_FIELDS),
    list(reversed(C.INPUT_FIELDS)),
    ["note", "amount", "customerId", "currency", "transactionDate", "transactionId"],
)


# Three complete layouts (every field present, in different orders).
FULL_LAYOUTS = (
    list(C.INPUT_FIELDS),
    list(reversed(C.INPUT_FIELDS)),
    ["currency", "transactionId", "sourceChannel", "amount", "customerId", "transactionDate"],
)


ROWS_A_FILE, STREAM_ROWS = 100_000, 4_000_000


def _bounded_files(raw: DataFrame, split: int) -> DataFrame:
    """Rows of one split, so partitioned and sorted that each ``block`` of them (at most
    ``ROWS_A_FILE`` rows, in row order) is written as one file by one task."""
    block = F.lpad(F.floor(F.col("row_number") / (3 * ROWS_A_FILE)).cast("string"), 9, "0")
    return (raw.filter(F.col("row_number") % 3 == split).withColumn("block", block)
            .repartition("block").sortWithinPartitions("block", "row_number"))


def _split_files(raw: DataFrame, rows: int | None):
    """(number, rows, partition columns) of each split: bounded files by row number, or, if
    ``rows`` is given, files of about that many rows each, however the row numbers lie."""
    if rows is None:
        for i in range(3):
            yield i, _bounded_files(raw, i), ["block"]
        return
    split = F.col("row_number") % 3
    count = {r.split: r["count"] for r in raw.groupBy(split.alias("split")).count().collect()}   # four rows at most
    for i in range(3):
        files = max(1, -(-count.get(i, 0) // rows))
        yield i, raw.filter(split == i).repartitionByRange(files, "row_number").sortWithinPartitions("row_number"), []


def write_csv_splits(raw: DataFrame, label: str = "csv",
                     layouts: tuple[list[str], ...] = LAYOUTS, rows: int | None = None) -> str:
    """CSV files of bounded rows in three splits (row_number % 3), each with its own header layout."""
    spark = raw.sparkSession
    out = scratch_path(spark, label)
    for i, part, by in _split_files(raw.withColumn("note", F.lit("x")), rows):
        (part.select(*by, *layouts[i]).write.partitionBy(*by)
         .option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(f"{out}/split={i}"))
    return out


def write_json_splits(raw: DataFrame, label: str = "json", rows: int | None = None) -> str:
    """JSON-lines files of bounded rows in three splits; the amount is written as a JSON number."""
    spark = raw.sparkSession
    out = scratch_path(spark, label)
    for i, part, by in _split_files(raw, rows):
        (part.select(*by, "customerId", "transactionId", "transactionDate",
                     F.col("amount").try_cast("decimal(38,10)").alias("amount"),
                     "currency", "sourceChannel")
         .write.partitionBy(*by).json(f"{out}/split={i}"))
    return out


UPLOAD_ROWS, UPLOAD_LINE = 3000, 21      # row numbers a file covers, bytes of each of its lines


def write_uploads(raw: DataFrame) -> str:
    """A folder of uploads to admit or refuse: ``kind=csv``, ``kind=txt`` (foreign) and
    ``kind=empty``, a zero-length file; a file holds ``UPLOAD_LINE`` bytes a row."""
    spark = raw.sparkSession
    out = scratch_path(spark, "uploads")
    rows = raw.select(F.floor(F.col("row_number") / UPLOAD_ROWS).alias("block"), "row_number",
                      F.lpad(F.col("row_number").cast("string"), UPLOAD_LINE - 1, "0").alias("line"))
    csv = rows.filter("row_number % 3 > 0").repartition("block").sortWithinPartitions("block")
    csv.select("block", "line").write.partitionBy("block").csv(f"{out}/kind=csv")
    foreign = rows.filter("row_number % 3 = 0").repartition("block").sortWithinPartitions("block")
    foreign.select("block", "line").write.partitionBy("block").text(f"{out}/kind=txt")
    rows.filter("false").select("line").coalesce(1).write.csv(f"{out}/kind=empty/block=0")
    return out
