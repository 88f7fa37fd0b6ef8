"""Stored tables and the adapters that present the test tables in the model.

The model has two stored tables (``transactions`` and ``customers``) and one
untyped input (``raw_transactions``: six string fields plus a row number).
On a deployment they are Parquet folders; for the test data they are views
over the ``orders`` and ``customer`` tables, defined column by column so the
same definitions can be written as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

TRANSACTION_COLUMNS = (
    "id",
    "customer_id",
    "external_transaction_id",
    "transaction_date",
    "amount",
    "currency",
    "source_channel",
    "created_at",
)
CUSTOMER_COLUMNS = ("id", "external_id", "created_at")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_transactions(df: DataFrame) -> DataFrame:
    """Explicit column list; Catalyst prunes the rest at the scan."""
    return df.select(*TRANSACTION_COLUMNS)


def scan_customers(df: DataFrame) -> DataFrame:
    """S5/P1."""
    return df.select(*CUSTOMER_COLUMNS)


# --- adapters over the test tables ------------------------------------------

def _currency_of(orderkey: Column) -> Column:
    r = orderkey % 5
    return (F.when(r == 0, "USD").when(r == 1, "EUR").when(r == 2, "GBP")
            .when(r == 3, "JPY").otherwise("CHF"))


def _channel_of(priority: Column) -> Column:
    return (F.when(priority == "1-URGENT", "web").when(priority == "2-HIGH", "mobile")
            .when(priority == "3-MEDIUM", "pos").when(priority == "4-NOT SPECIFIED", "api")
            .otherwise("import"))


def _txn_external_id(orderkey: Column) -> Column:
    return F.concat(F.lit("TXN-"), F.lpad(orderkey.cast("string"), 10, "0"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ``transactions`` table presented over ``orders``."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.md5(F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        _txn_external_id(F.col("o_orderkey")).alias("external_transaction_id"),
        F.col("o_orderdate").alias("transaction_date"),
        F.col("o_totalprice").cast(C.STORED_DECIMAL).alias("amount"),
        _currency_of(F.col("o_orderkey")).alias("currency"),
        _channel_of(F.col("o_orderpriority")).alias("source_channel"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("created_at"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ``customers`` table presented over ``customer``."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("external_id"),
        F.lit("1995-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )


def stored_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is already in the store before an ingest: ids ending in ``0``."""
    t = transactions(spark, sf_dir)
    return t.filter(F.substring("external_transaction_id", -1, 1) == "0")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty all-string input rows derived from ``orders`` (k = orderkey % 40).

    Each value of k plants one kind of defect; see FIXTURES.md B.4.
    """
    o = read_table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    k = ok % 40
    cust_name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    date_text = F.concat(F.replace(F.col("o_orderdate").cast("string"), F.lit(" "), F.lit("T")),
                         F.lit("Z"))
    price_text = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return o.select(
        (ok + 1).alias("row_number"),
        F.when(k.isin(1, 26), "").when(k == 2, F.repeat(F.lit("C"), 101))
        .otherwise(cust_name).alias("customerId"),
        F.when(k == 3, "   ").when(k == 4, F.repeat(F.lit("T"), 256))
        .when(k == 29, _txn_external_id(ok - 1))
        .otherwise(_txn_external_id(ok)).alias("transactionId"),
        F.when(k == 7, "").when(k == 8, "not-a-date").when(k == 9, "2002-01-01T00:00:01Z")
        .when(k == 12, "1991-01-01T00:00:00Z")
        .otherwise(date_text).alias("transactionDate"),
        F.when(k == 11, "").when(k == 13, "abc").when(k.isin(14, 26), "0")
        .when(k == 15, "-5.00").when(k == 16, "1000000000").when(k == 17, "1e3")
        .when(k == 18, "1,234.56785").when(k == 19, "0.00004")
        .otherwise(price_text).alias("amount"),
        F.when(k == 21, "usd").when(k == 22, "USDD").when(k == 23, "").when(k == 24, "12A")
        .otherwise(_currency_of(ok)).alias("currency"),
        F.when(k.isin(25, 26), "desk").when(k == 27, "").when(k == 31, "WEB")
        .otherwise(_channel_of(F.col("o_orderpriority"))).alias("sourceChannel"),
    )


def _event_channel(event_type: Column) -> Column:
    return (F.when(event_type == "signup", "web").when(event_type == "view", "mobile")
            .when(event_type == "click", "pos").when(event_type == "purchase", "api")
            .otherwise("import"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean all-string input rows derived from ``events`` (January 2024).

    Every customer here is new to the customers table (``User#`` ids), so
    this input exercises customer creation; ingest it with a clock after
    January 2024.
    """
    e = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        (eid + 1).alias("row_number"),
        F.concat(F.lit("User#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("customerId"),
        F.concat(F.lit("EVT-"), F.lpad(eid.cast("string"), 10, "0")).alias("transactionId"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("transactionDate"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("amount"),
        _currency_of(eid).alias("currency"),
        _event_channel(F.col("event_type")).alias("sourceChannel"),
    )
