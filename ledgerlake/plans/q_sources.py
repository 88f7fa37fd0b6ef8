"""Registered source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import csv_split, files, tables
from .fixtures import (
    ROWS_A_FILE, UPLOAD_LINE, UPLOAD_ROWS, write_csv_splits, write_json_splits, write_uploads)
from .registry import register

SPLIT_ROW = (f"row_number() OVER (PARTITION BY row_number % 3, row_number // {3 * ROWS_A_FILE} "
             "ORDER BY row_number)")


@register("scan_transactions", "SELECT * FROM transactions")
def q_scan_transactions(spark, sf):
    return tables.scan_transactions(tables.transactions(spark, sf))


@register("scan_customers", "SELECT * FROM customers")
def q_scan_customers(spark, sf):
    return tables.scan_customers(tables.customers(spark, sf))


@register("scan_csv_by_header", f"""
SELECT {SPLIT_ROW} AS row_number, customerId, transactionId, transactionDate, amount, currency,
       CASE WHEN row_number % 3 = 2 THEN '' ELSE sourceChannel END AS sourceChannel
FROM raw_transactions""")
def q_scan_csv_by_header(spark, sf):
    path = write_csv_splits(tables.raw_transactions(spark, sf))
    df = files.read_csv_by_header(spark, path)
    return df.drop("source_file", "row_key")


BROKEN = """CASE WHEN row_number % 7 = 0 THEN chr(10) || 'a "quoted"' || chr(10) || chr(10) || ', line'
                 WHEN row_number % 11 = 0 THEN '"' || chr(13) || chr(10) ELSE '' END"""


@register("scan_csv_quoted_breaks", f"""
SELECT {SPLIT_ROW} AS row_number, customerId || {BROKEN} AS customerId, transactionId, transactionDate,
       amount, currency, CASE WHEN row_number % 3 = 2 THEN '' ELSE sourceChannel END AS sourceChannel
FROM raw_transactions""")
def q_scan_csv_quoted_breaks(spark, sf):
    # fields with line breaks, empty lines, quotes and commas; files are read block by block
    raw = tables.raw_transactions(spark, sf).withColumn(
        "customerId", F.concat("customerId", F.expr(BROKEN)))
    path = write_csv_splits(raw, "csv-breaks")
    return csv_split.read_csv_split(spark, path).drop("source_file", "row_key")


@register("row_numbers", f"""
SELECT transactionId, {SPLIT_ROW} AS row_number FROM raw_transactions""")
def q_row_numbers(spark, sf):
    path = write_csv_splits(tables.raw_transactions(spark, sf), "rownum")
    return files.read_csv_by_header(spark, path, multi_line=False) \
        .select("transactionId", "row_number")


@register("scan_json_records", f"""
SELECT {SPLIT_ROW} AS row_number, customerId, transactionId,
       try_cast(amount AS DECIMAL(38,10)) AS txn_amount, currency, sourceChannel
FROM raw_transactions""")
def q_scan_json_records(spark, sf):
    path = write_json_splits(tables.raw_transactions(spark, sf))
    return files.read_json_records(spark, path).select(
        "row_number", "customerId", "transactionId", "txn_amount", "currency", "sourceChannel")


MAX_UPLOAD = UPLOAD_LINE * (UPLOAD_ROWS // 2)


@register("admit_files", f"""
SELECT kind, block, length, CASE WHEN kind = 'txt' THEN 'not_csv' WHEN length > {MAX_UPLOAD} THEN 'too_large' END AS reason,
       kind = 'csv' AND length <= {MAX_UPLOAD} AS admitted
FROM (SELECT CASE WHEN row_number % 3 > 0 THEN 'csv' ELSE 'txt' END AS kind,
             CAST(row_number // {UPLOAD_ROWS} AS BIGINT) AS block, CAST(count(*) * {UPLOAD_LINE} AS BIGINT) AS length
      FROM raw_transactions GROUP BY 1, 2)
UNION ALL SELECT 'empty', CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'empty', false""")
def q_admit_files(spark, sf):
    # csv files within and over the size cap, foreign files and an empty file
    admitted = files.admit_files(spark, write_uploads(tables.raw_transactions(spark, sf)), MAX_UPLOAD)
    return admitted.select(
        F.regexp_extract("path", "kind=([a-z]+)", 1).alias("kind"),
        F.regexp_extract("path", "block=([0-9]+)", 1).cast("bigint").alias("block"), "length", "reason", "admitted")


@register("unnest_parallel_arrays", "SELECT * FROM customers")
def q_unnest_parallel_arrays(spark, sf):
    from ..sources.inline import chunked_parallel_arrays, unnest_parallel_arrays
    chunks = chunked_parallel_arrays(tables.customers(spark, sf),
                                     ("id", "external_id", "created_at"))
    return unnest_parallel_arrays(chunks, ("id", "external_id", "created_at"))
