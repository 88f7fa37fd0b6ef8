"""Statistics and pages from partial aggregates kept with every run of the store.

A run keeps, for each label, customer, day, currency and channel, the number of
rows, their exact total and their first and last date. All summary statistics
are sums, minima and maxima of these, and the exact distinct count of customers
is a distinct count over them, so no statistic scans the transactions. A replay
replaces its label's partial aggregates with the label.

The same table finds a page without reading what lies before it: the customer's
daily counts, newest first, give the days that the wanted rows fall into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config as C
from ..sources import store
from . import paging

KEYS = store.SUMMARY_KEYS


def partial_summaries(tx: DataFrame) -> DataFrame:
    """Partial aggregates of stored rows; by label too where the rows carry it.

    Rows meet by ranges of customer and day, which is the order they are written in, so
    the aggregate, hardly smaller than the rows, needs no exchange of its own.
    """
    label = [c for c in ("ingest_batch",) if c in tx.columns]
    return (tx.select(*label, *[k for k in KEYS if k != "txn_day"], "amount", "transaction_date",
                      F.to_date("transaction_date").alias("txn_day"))
            .repartitionByRange("customer_id", "txn_day").groupBy(*label, *KEYS)
            .agg(F.count(F.lit(1)).alias("txn_count"), F.coalesce(F.sum("amount"), F.lit(0)).cast(C.SUM_DECIMAL).alias("total_amount"),
                 F.min("transaction_date").alias("oldest"), F.max("transaction_date").alias("newest")))


def _sums() -> list[Column]:
    return [F.sum("txn_count").alias("txn_count"), F.sum("total_amount").cast(C.SUM_DECIMAL).alias("total_amount")]


def stats_total(snap) -> DataFrame:
    """A1-A3: one row, also for an empty store (min/max are then null)."""
    return snap.read("summaries").agg(
        F.coalesce(F.sum("txn_count"), F.lit(0)).alias("total_transactions"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.min("oldest").alias("oldest_transaction"), F.max("newest").alias("newest_transaction"))


def stats_by_currency(snap) -> DataFrame:
    """A4."""
    return snap.read("summaries").groupBy("currency").agg(*_sums()).orderBy("currency")


def stats_by_channel(snap) -> DataFrame:
    """A5."""
    return snap.read("summaries").groupBy(F.col("source_channel").alias("channel")).agg(*_sums()).orderBy("channel")


def stats_by_customer(snap, key: str, out: str) -> DataFrame:
    """Per external customer id and currency or channel."""
    names = snap.read("customers").groupBy(F.col("id").alias("customer_id")).agg(F.min("external_id").alias("customer"))
    return (snap.read("summaries").groupBy("customer_id", F.col(key).alias(out)).agg(*_sums())
            .join(names, "customer_id").select("customer", out, "txn_count", "total_amount").orderBy("customer", out))


def approx_customers(snap, relative_error: float = 0.02) -> DataFrame:
    """A2 as a sketch, for callers who don't need the exact number."""
    return snap.read("summaries").agg(F.approx_count_distinct("customer_id", relative_error).alias("unique_customers"))


# -- pages ------------------------------------------------------------------------------------------------------

def _days(snap, cid: str, window, currency, channel) -> DataFrame:
    """Rows a day of one customer, under the filters that whole days can answer."""
    day = snap.read("summaries").where(F.col("customer_id") == cid)
    if currency is not None:
        day = day.where(F.col("currency") == currency)
    if channel is not None:
        day = day.where(F.col("source_channel") == channel)
    return day.where(F.col("txn_day").between(F.to_date(window.lower), F.to_date(window.upper)))


def _rows(snap, cid: str, window, currency, channel) -> DataFrame:
    return paging.filter_transactions(store.customer_transactions(snap, cid), cid, window, currency, channel)


def seek_page(snap, req: paging.PageRequest) -> DataFrame:
    """O2: page ``req.page`` (newest first), reading only the days that its rows fall into.

    The first and last day of the window may be cut by the hour, so the rows of
    the last day are counted as stored; all other days count by their summaries.
    One customer's days are at most some thousand rows.
    """
    paging.check_range(req)
    norm, window = paging.normalize(req)
    cid = paging.resolve_customer_id(snap.read("customers"), norm.customer)
    first, last = (norm.page - 1) * norm.page_size + 1, norm.page * norm.page_size
    day = _days(snap, cid, window, norm.currency, norm.channel).groupBy("txn_day").agg(F.sum("txn_count").alias("n"))
    rows = _rows(snap, cid, window, norm.currency, norm.channel)
    cut = rows.where(F.to_date("transaction_date") == F.to_date(window.upper)).agg(F.count(F.lit(1)).alias("n"))
    whole = day.where(F.col("txn_day") < F.to_date(window.upper))
    day = whole.unionByName(cut.select(F.to_date(window.upper).alias("txn_day"), "n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(cid)).orderBy(F.desc("txn_day")))
    hit = (day.select("txn_day", "n", upto.alias("upto")).where((F.col("upto") >= first) & (F.col("upto") - F.col("n") < last))
           .agg(F.min("txn_day").alias("low"), F.max("txn_day").alias("high"), F.min(F.col("upto") - F.col("n")).alias("before")).first())
    items = rows.select(F.lit(norm.customer).alias("customer"), *paging.ITEM_COLUMNS, "id", "txn_month")
    if hit.low is None:
        return items.where("false").select("customer", *paging.ITEM_COLUMNS)
    near = items.where(F.to_date("transaction_date").between(F.lit(hit.low), F.lit(hit.high)))
    # whole instants, so that the bounds reach the scan; months prune folders
    near = near.where((F.col("transaction_date") >= F.lit(hit.low).cast("timestamp_ntz"))
                      & (F.col("transaction_date") < F.date_add(F.lit(hit.high), 1).cast("timestamp_ntz"))
                      & F.col("txn_month").between(hit.low.strftime("%Y-%m"), hit.high.strftime("%Y-%m")))
    return (near.orderBy(*paging.newest_first()).offset(first - 1 - hit.before).limit(norm.page_size)
            .select("customer", *paging.ITEM_COLUMNS))


def page_after(snap, req: paging.PageRequest, after: tuple | None = None) -> DataFrame:
    """O2: the rows that follow a cursor (date, id) of the page before; the first page without one.

    Items carry their ``id``, which with their date is the next cursor.
    """
    paging.check_range(req)
    norm, window = paging.normalize(req)
    cid = paging.resolve_customer_id(snap.read("customers"), norm.customer)
    rows = _rows(snap, cid, window, norm.currency, norm.channel)
    if after is not None:
        at, ident = F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1])
        rows = rows.where((F.col("transaction_date") <= at) & (F.col("txn_month") <= F.date_format(at, "yyyy-MM"))
                          & ((F.col("transaction_date") < at) | (F.col("id") < ident)))
    return (rows.orderBy(*paging.newest_first()).limit(norm.page_size)
            .select(F.lit(norm.customer).alias("customer"), *paging.ITEM_COLUMNS, "id"))


def page_total(snap, req: paging.PageRequest) -> DataFrame:
    """Total and pages. Days wholly inside the window count by their summaries."""
    norm, window = paging.normalize(req)
    cid = paging.resolve_customer_id(snap.read("customers"), norm.customer)
    edge = [F.to_date(window.lower), F.to_date(window.upper)]
    inner = _days(snap, cid, window, norm.currency, norm.channel).where(~F.col("txn_day").isin(*edge))
    outer = _rows(snap, cid, window, norm.currency, norm.channel).where(F.to_date("transaction_date").isin(*edge))
    both = inner.agg(F.sum("txn_count").alias("n")).unionByName(outer.agg(F.count(F.lit(1)).alias("n")))
    size = F.lit(norm.page_size)
    return (both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"))
            .select("total_count", F.lit(norm.page).alias("page"), size.alias("page_size"),
                    paging.page_count(F.col("total_count"), size).alias("total_pages")))
