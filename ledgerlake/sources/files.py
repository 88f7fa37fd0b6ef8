"""File sources: CSV mapped by header name, JSON records, file admission,
per-file row numbers (S1, S2, S3, W2).

CSV by header. A schema given to the CSV reader maps columns by position,
and files read together share one header. Here every file is read with a
wide positional all-string schema; each file's first record is its header;
a small per-file table gives the position of every wanted field in that
file; data rows pick their fields by those positions. Files with different
column orders, missing columns or extra columns are all read in one scan,
without listing or opening files on the driver. Field names match
case-sensitively; a missing column or field reads as "".

Row numbers. ``monotonically_increasing_id`` grows within a task and a task
reads a file block's records in order, so per (file, block) the row within
the block is ``id - min(id)``. The block counts of a file, prefixed-summed
(a window over the blocks of one file: one row per block), give each block
its offset. No step orders all rows globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from .listing import list_files

ROW_BITS = 40           # row_key = file ordinal << 40 | row number


def _row_key(file_no, row):
    """Ingest order; fails loudly where the file ordinal would not fit."""
    key = F.shiftleft(file_no.cast("bigint"), ROW_BITS) + row
    return F.when(file_no < (1 << (63 - ROW_BITS)), key).otherwise(
        F.raise_error(F.lit("too many files in one read for the row key")).cast("bigint"))


def _header_width(spark: SparkSession, path: str | list[str]) -> int:
    """Positional columns that hold the widest header of the files: the commas of
    each file's first line, quoted ones too, so never too few."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("i"), F.regexp_count("value", F.lit(",")).alias("n"))
    first = lines.groupBy("f").agg(F.min_by("n", F.struct("b", "i")).alias("n"))
    return (first.agg(F.max("n")).first()[0] or 0) + 2


def _numbered(df: DataFrame) -> DataFrame:
    """Adds ``source_file``, ``row_in_file`` (1-based record number) and
    ``_file_no`` (ordinal of the file in name order) with one aggregate over
    (file, block) and one join with its one-row-per-block result."""
    tagged = df.select("*", F.col("_metadata.file_path").alias("source_file"),
                       F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_mid"))
    blocks = (tagged.groupBy("source_file", "_block")
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first")))
    before = Window.partitionBy("source_file").orderBy("_block") \
        .rowsBetween(Window.unboundedPreceding, -1)
    info = _file_ordinals(blocks.select(
        "source_file", "_block", "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    return (tagged.join(info, ["source_file", "_block"])
            .withColumn("row_in_file", F.col("_offset") + F.col("_mid") - F.col("_first") + 1)
            .drop("_block", "_mid", "_offset", "_first"))


def _file_ordinals(files: DataFrame) -> DataFrame:
    """Ordinal of each file path in name order.

    The input has one row per file (or per file block), so this single
    ordered window sorts the file list, not the data.
    """
    return files.withColumn("_file_no", F.dense_rank().over(Window.orderBy("source_file")) - 1)


def read_csv_by_header(spark: SparkSession, path: str | list[str],
                       fields: tuple[str, ...] = C.INPUT_FIELDS,
                       multi_line: bool = True, width: int | None = None) -> DataFrame:
    """All-string rows with ``source_file``, ``row_number`` (data rows from
    1, the header not counted) and ``row_key`` (file order, then row).

    Every record is read as a positional array, and the would-be position of
    each wanted field in it is computed (meaningful only for a header). One
    hash aggregate over (file, block) keeps the record count, the first id
    and, via ``min_by``, the positions seen in the block's first record; a
    window over the blocks of a file (one row per block) turns the counts
    into offsets and hands the first block's positions (the header's) to all
    blocks. Data rows then need one join with that one-row-per-block table:
    two passes over the input, no sort of the data. ``multi_line`` keeps
    quoted line breaks inside one record (each file is then read by one
    task); turn it off for large files without them. ``width`` is the number of
    positional columns; by default the widest header decides. A header that does
    not fit (a given width, a header with quoted line breaks) is an error,
    whichever columns are selected.
    """
    width = width or _header_width(spark, path)
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    raw = (spark.read.schema(schema).option("header", False).option("multiLine", multi_line)
           .option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    cells = F.array(*[F.col(f"_c{i}") for i in range(width)])
    tagged = raw.select(cells.alias("_cells"),
                        F.col("_metadata.file_path").alias("source_file"),
                        F.col("_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_mid"))
    positions = tagged.select("source_file", "_block", "_mid",
                              *[F.array_position("_cells", f).cast("int").alias(f"_p_{f}")
                                for f in fields],
                              F.element_at("_cells", width).isNotNull().alias("_p_full"))
    blocks = (positions.groupBy("source_file", "_block")
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"),
                   *[F.min_by(f"_p_{f}", "_mid").alias(f"_h_{f}") for f in fields],
                   F.min_by("_p_full", "_mid").alias("_h_full")))
    per_file = Window.partitionBy("source_file").orderBy("_block")
    before = per_file.rowsBetween(Window.unboundedPreceding, -1)
    info = _file_ordinals(blocks.select(
        "source_file", "_block", "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        *[F.first(f"_h_{f}").over(per_file).alias(f"_pos_{f}") for f in fields],
        F.first("_h_full").over(per_file).alias("_full")))
    rows = (tagged.join(info, ["source_file", "_block"])
            .withColumn("row_in_file", F.col("_offset") + F.col("_mid") - F.col("_first") + 1)
            .filter(F.col("row_in_file") > 1)
            # a header that fills every positional column may hide wanted fields
            # beyond them: fail loudly rather than read them as missing
            .filter(F.when(F.col("_full"), F.raise_error(F.concat(
                F.lit(f"CSV header has {width} or more columns: "), F.col("source_file"))).cast("boolean"))
                .otherwise(F.lit(True))))
    picked = [F.coalesce(F.when(F.col(f"_pos_{f}") > 0,
                                F.element_at("_cells", F.col(f"_pos_{f}"))), F.lit("")).alias(f)
              for f in fields]
    row_number = (F.col("row_in_file") - 1).alias("row_number")
    row_key = _row_key(F.col("_file_no"), F.col("row_in_file") - 1).alias("row_key")
    return rows.select("source_file", row_number, row_key, *picked)


JSON_SCHEMA = T.StructType([
    T.StructField("customerId", T.StringType()),
    T.StructField("transactionId", T.StringType()),
    T.StructField("transactionDate", T.StringType()),
    T.StructField("amount", T.DecimalType(38, 10)),
    T.StructField("currency", T.StringType()),
    T.StructField("sourceChannel", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_json_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One typed record per JSON line, ready for ``validate_typed_rows``.

    The amount is a JSON number read as decimal(38,10); the date is ISO text.
    A line that does not parse, an amount that is not a number, or a date
    text outside the ISO grammar marks the record corrupt (the original
    refuses such a body before validation).
    """
    from ..functions.parsing import _iso_timestamp  # ISO-only for typed dates

    df = (spark.read.schema(JSON_SCHEMA).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    rows = _numbered(df)
    date = _iso_timestamp(F.col("transactionDate"))
    bad_date = F.col("transactionDate").isNotNull() & date.isNull()
    return rows.select(
        "source_file", F.col("row_in_file").alias("row_number"),
        _row_key(F.col("_file_no"), F.col("row_in_file")).alias("row_key"),
        "customerId", "transactionId", "transactionDate", "currency", "sourceChannel",
        date.alias("txn_date"), F.col("amount").alias("txn_amount"),
        F.when(bad_date, F.coalesce(F.col("_corrupt_record"), F.col("transactionDate")))
        .otherwise(F.col("_corrupt_record")).alias("_corrupt_record"))


def admit_files(spark: SparkSession, path: str | list[str], max_bytes: int | None = None,
                extension: str = ".csv") -> DataFrame:
    """S3: one row per file with ``admitted`` and a ``reason``.

    Files are listed, never opened; zero-length files are listed too (see
    ``listing``). The size cap is off unless given (the original's cap was an
    HTTP limit). The extension counts in any case of letters.
    """
    files = list_files(spark, path).select("path", "length")
    reason = (F.when(F.col("length") == 0, F.lit("empty"))
              .when(~F.lower(F.col("path")).endswith(extension), F.lit("not_" + extension.lstrip("."))))
    if max_bytes is not None:
        reason = reason.when(F.col("length") > max_bytes, F.lit("too_large"))
    return files.select("path", "length", reason.alias("reason"),
                        reason.isNull().alias("admitted"))
