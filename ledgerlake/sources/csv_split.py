"""CSV with quoted line breaks, read by blocks instead of by whole files.

The multi-line CSV reader opens a file from its start, so one large file is one
task. Here the blocks of a file are read side by side as plain lines, and what a
block must know of its predecessors is carried by one small row for each block:

1. A line with an odd number of quotes opens or closes a quoted field. The sum of
   these in a block, modulo two, says whether the block turns "inside quotes" round;
   summed over the blocks before it, it gives the state the block starts in.
2. Within a block, running sums tell for each line, under either starting state,
   whether it starts a record and how many records started up to it. A window over
   the rows of one block needs no more memory than a block.
3. The counts of a file's blocks, summed in order, number the records of the file.
   Lines of one number are one record, across block borders too.

Records on one line (nearly all) go straight to the parser; only the lines of
broken records are gathered by (file, number) and put together. All lines cross one
exchange, by (file, block); both uses of it share it.

Defined results: lines end with LF or CRLF; empty lines outside quotes are no
records; a quoted field keeps its line breaks as they are. Quotes follow RFC 4180
(a field with a quote is quoted and the quote doubled). A file whose last quote is
never closed, or whose header line breaks inside quotes, is an error: the rest of
the file would be one record. An empty file has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from .files import _file_ordinals, _header_width, _row_key

BLOCK = ["source_file", "_block"]


def _quotes(text):
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _unless(fault, message: str):
    """A filter that fails the read, naming the file, where ``fault`` holds."""
    named = F.concat(F.lit(f"{message}: "), F.col("source_file"))
    return F.when(fault, F.raise_error(named).cast("boolean")).otherwise(F.lit(True))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of every block with ``_odd`` (1: an odd number of quotes) and ``_text`` (not empty)."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"), "value",
        (_quotes(F.col("value")) % 2).alias("_odd"), (~F.col("value").isin("", "\r")).cast("int").alias("_text"))


def _within_blocks(lines: DataFrame) -> DataFrame:
    """Adds ``_turned`` (quotes before the line in its block, modulo two) and the records
    started up to the line if the block begins outside (``_n0``) or inside (``_n1``) quotes."""
    order = Window.partitionBy(*BLOCK).orderBy("_mid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = lines.withColumn("_turned", F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2)
    return (turned
            .withColumn("_n0", F.sum(F.col("_text") * (1 - F.col("_turned"))).over(upto))
            .withColumn("_n1", F.sum(F.col("_text") * F.col("_turned")).over(upto)))


def _block_table(lines: DataFrame) -> DataFrame:
    """One row a block: the state it starts in, the records before it, and its file's
    ordinal, header line and whether the file's quotes are closed."""
    blocks = lines.groupBy(*BLOCK).agg(
        (F.sum("_odd") % 2).alias("_turns"), F.max("_n0").alias("_m0"), F.max("_n1").alias("_m1"),
        F.min_by("value", F.when(F.col("_text") == 1, F.col("_mid"))).alias("_first"))
    per_file = Window.partitionBy("source_file").orderBy("_block")
    before = per_file.rowsBetween(Window.unboundedPreceding, -1)
    whole = per_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = F.coalesce(F.sum("_turns").over(before), F.lit(0)) % 2
    stated = blocks.select(
        *BLOCK, inside.alias("_inside"), F.when(inside == 0, F.col("_m0")).otherwise(F.col("_m1")).alias("_m"),
        F.first("_first", ignorenulls=True).over(whole).alias("_header"),
        (F.sum("_turns").over(whole) % 2 == 0).alias("_closed"))
    return _file_ordinals(stated.withColumn("_offset", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m"))


def _strip_cr(text):
    return F.when(F.endswith(text, F.lit("\r")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def read_csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source_file``, ``_file_no``, ``_header`` (the file's header line), ``_record``
    (number in the file from 1, the header's) and ``value`` (the record's text)."""
    lines = _within_blocks(_lines(spark, path))
    inside = (F.col("_turned") + F.col("_inside")) % 2
    number = F.col("_offset") + F.when(F.col("_inside") == 0, F.col("_n0")).otherwise(F.col("_n1"))
    numbered = (lines.join(_block_table(lines), BLOCK)
                .filter(_unless(~F.col("_closed"), "CSV with a quote that is never closed"))
                .filter(_unless(_quotes(F.col("_header")) % 2 == 1, "CSV with a header over several lines"))
                .withColumn("_in", inside).withColumn("_record", number)
                .filter((F.col("_text") == 1) | (F.col("_in") == 1)))
    one_line = (F.col("_in") == 0) & (F.col("_odd") == 0)
    singles = numbered.filter(one_line).select("source_file", "_file_no", "_header", "_record", "value")
    # a record that is broken over lines, in file order
    parts = F.sort_array(F.collect_list(F.struct("_block", "_mid", "value")))
    broken = (numbered.filter(~one_line).groupBy("source_file", "_record")
              .agg(F.first("_file_no").alias("_file_no"), F.first("_header").alias("_header"), parts.alias("_parts"))
              .select("source_file", "_file_no", "_header", "_record",
                      F.array_join(F.col("_parts.value"), "\n").alias("value")))
    return singles.unionByName(broken).withColumn("value", _strip_cr(F.col("value")))


def read_csv_split(spark: SparkSession, path: str | list[str], fields: tuple[str, ...] = C.INPUT_FIELDS,
                   width: int | None = None) -> DataFrame:
    """The columns and rows of ``read_csv_by_header(multi_line=True)``, with a task a block.

    ``width`` is the number of positional columns; by default the widest header decides.
    """
    width = width or _header_width(spark, path)
    schema = ", ".join(f"_c{i} string" for i in range(width))
    options = {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}

    def cells(text):
        row = F.from_csv(text, schema, options)
        return F.array(*[row.getField(f"_c{i}") for i in range(width)])

    head = cells(_strip_cr(F.col("_header")))
    records = read_csv_records(spark, path)
    fits = _unless(F.element_at("_head", width).isNotNull(), f"CSV header has {width} or more columns")
    rows = (records.filter(F.col("_record") > 1).withColumn("_head", head).filter(fits)
            .withColumn("_cells", cells(F.col("value"))))
    picked = [F.coalesce(F.element_at("_cells", F.nullif(F.array_position("_head", f), F.lit(0)).cast("int")),
                         F.lit("")).alias(f) for f in fields]
    return rows.select("source_file", (F.col("_record") - 1).alias("row_number"),
                       _row_key(F.col("_file_no"), F.col("_record") - 1).alias("row_key"), *picked)
