"""Summary statistics over stored transactions (grand total and breakdowns).

All breakdowns aggregate on the surrogate ``customer_id`` before joining to
``customers`` for the external id: the join then sees one row per
(customer, key) instead of one per transaction, and a hot customer is
reduced map-side by the partial aggregate before any shuffle. The join
strategy is left to Catalyst/AQE (broadcast only when the size estimate of
the customers side is under the session threshold).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


def _total_amount(col: str = "amount") -> Column:
    # COALESCE(SUM(amount), 0), widened to one declared type for every engine.
    return F.coalesce(F.sum(col), F.lit(0)).cast(C.SUM_DECIMAL).alias("total_amount")


def stats_total(tx: DataFrame) -> DataFrame:
    """A1-A3: one row, also on empty input (min/max are then null)."""
    return tx.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.min("transaction_date").alias("oldest_transaction"),
        F.max("transaction_date").alias("newest_transaction"),
    )


def _by_key(tx: DataFrame, key: str, out: str) -> DataFrame:
    return (tx.groupBy(F.col(key).alias(out))
            .agg(F.count(F.lit(1)).alias("txn_count"), _total_amount())
            .orderBy(out))


def stats_by_currency(tx: DataFrame) -> DataFrame:
    """A4: count and total per currency, ordered by currency."""
    return _by_key(tx, "currency", "currency")


def stats_by_channel(tx: DataFrame) -> DataFrame:
    """A5: count and total per source channel, ordered by channel."""
    return _by_key(tx, "source_channel", "channel")


def _by_customer_and(tx: DataFrame, customers: DataFrame, key: str, out: str) -> DataFrame:
    per_customer = (tx.groupBy("customer_id", F.col(key).alias(out))
                    .agg(F.count(F.lit(1)).alias("txn_count"), _total_amount()))
    names = customers.select(F.col("id").alias("customer_id"), "external_id")
    return (per_customer.join(names, "customer_id", "inner")
            .select(F.col("external_id").alias("customer"), out, "txn_count", "total_amount")
            .orderBy("customer", out))


def stats_by_customer_currency(tx: DataFrame, customers: DataFrame) -> DataFrame:
    """Per external customer id and currency."""
    return _by_customer_and(tx, customers, "currency", "currency")


def stats_by_customer_channel(tx: DataFrame, customers: DataFrame) -> DataFrame:
    """Per external customer id and source channel."""
    return _by_customer_and(tx, customers, "source_channel", "channel")


def stats_grouping_sets(tx: DataFrame, customers: DataFrame,
                        include_customer_breakdowns: bool = True) -> DataFrame:
    """Every breakdown from one scan, tagged by grain.

    ``GROUPING SETS`` expands each row once per set before the partial
    aggregate, so the scan and the shuffle happen once for all grains.
    Customer grains are planned only when asked for, as in the original.
    """
    cid, cur, chan = F.col("customer_id"), F.col("currency"), F.col("source_channel")
    sets = [[cur], [chan]]
    if include_customer_breakdowns:
        sets += [[cid, cur], [cid, chan]]
    grouped = (tx.groupingSets(sets, cid, cur, chan)
               .agg(F.count(F.lit(1)).alias("txn_count"), _total_amount(),
                    F.grouping_id(cid, cur, chan).alias("gid")))
    # grouping_id bits: customer_id 4, currency 2, source_channel 1 (set = rolled up)
    grain = (F.when(F.col("gid") == 5, "currency")
             .when(F.col("gid") == 6, "channel")
             .when(F.col("gid") == 1, "customer_currency")
             .otherwise("customer_channel"))
    names = customers.select(F.col("id").alias("customer_id"), "external_id")
    return (grouped.withColumn("grain", grain)
            .join(names, "customer_id", "left")
            # inner-join semantics for the customer grains (orphans drop out)
            .filter(F.col("gid").isin(5, 6) | F.col("external_id").isNotNull())
            .select("grain", F.col("external_id").alias("customer"), "currency",
                    F.col("source_channel").alias("channel"), "txn_count", "total_amount"))


def stats_document(tx: DataFrame) -> DataFrame:
    """One nested summary row (grand total + bounded breakdown lists).

    Only the two bounded grains are nested: currency is three letters and the
    channel set is closed, so each list has a fixed upper size. Customer
    grains stay tables. The pieces are stacked and folded by one global
    aggregate over at most a few thousand rows.
    """
    total = stats_total(tx).select("*", F.lit(None).cast("struct<currency:string,"
                                                          "txn_count:bigint,total_amount:"
                                                          f"{C.SUM_DECIMAL}>").alias("cur"),
                                   F.lit(None).cast("struct<channel:string,txn_count:bigint,"
                                                    f"total_amount:{C.SUM_DECIMAL}>").alias("chan"))
    cur = stats_by_currency(tx).select(F.struct("currency", "txn_count", "total_amount").alias("cur"))
    chan = stats_by_channel(tx).select(F.struct("channel", "txn_count", "total_amount").alias("chan"))
    stacked = total.unionByName(cur, allowMissingColumns=True).unionByName(
        chan, allowMissingColumns=True)
    return stacked.agg(
        F.max("total_transactions").alias("total_transactions"),
        F.max("unique_customers").alias("unique_customers"),
        F.max("oldest_transaction").alias("oldest_transaction"),
        F.max("newest_transaction").alias("newest_transaction"),
        F.sort_array(F.collect_list("cur")).alias("by_currency"),
        F.sort_array(F.collect_list("chan")).alias("by_channel"),
    )


@dataclass
class SummaryStats:
    total: DataFrame
    by_currency: DataFrame
    by_channel: DataFrame
    by_customer_currency: DataFrame | None = None
    by_customer_channel: DataFrame | None = None


def summary(tx: DataFrame, customers: DataFrame,
            include_customer_breakdowns: bool = False) -> SummaryStats:
    """The summary request: four scalars and two or four breakdowns."""
    out = SummaryStats(stats_total(tx), stats_by_currency(tx), stats_by_channel(tx))
    if include_customer_breakdowns:
        out.by_customer_currency = stats_by_customer_currency(tx, customers)
        out.by_customer_channel = stats_by_customer_channel(tx, customers)
    return out
