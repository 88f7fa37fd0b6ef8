"""Customer transaction pages.

A page request names a customer by external id. The id is resolved to the
surrogate key first (one row, bounded by the unique external id), so the
customer predicate is a literal that Catalyst pushes into the Parquet scan
together with the date, currency and channel predicates; only the filtered
rows reach the top-k sort (``TakeOrderedAndProject`` with offset).

The total is a separate aggregate over the same filtered rows, not
``COUNT(*) OVER ()``: an empty window spec would move every filtered row to
one partition. Page totals are the true totals, also past the last page.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.parsing import page_count, parse_timestamp, utc_now


class CustomerNotFound(LookupError):
    """the requested external customer id is not in the customers table."""


@dataclass(frozen=True)
class PageRequest:
    customer: str
    page: int = C.DEFAULT_PAGE
    page_size: int = C.DEFAULT_PAGE_SIZE
    from_date: str | None = None
    to_date: str | None = None
    currency: str | None = None
    channel: str | None = None
    as_of: str | None = None          # the "now" that a missing to_date defaults to


def clamp_api(req: PageRequest) -> PageRequest:
    """F9 (API layer): page at least 1, size between 1 and 100."""
    return replace(req, page=max(req.page, 1),
                   page_size=min(max(req.page_size, 1), C.MAX_PAGE_SIZE))


def _instant(text: str) -> dt.datetime:
    value = dt.datetime.fromisoformat(text.strip())
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def check_range(req: PageRequest) -> None:
    """both bounds given and from after to is a request error."""
    if req.from_date and req.to_date and _instant(req.from_date) > _instant(req.to_date):
        raise ValueError("from_date must not be after to_date")


def _optional(text: str | None) -> str | None:
    """blank filter text means no filter."""
    return text if text is not None and text.strip() else None


def _ts(text: str | None) -> Column:
    """A request bound as UTC wall-clock (an offset in the text is applied)."""
    if text is None:
        return utc_now()
    # the datetime parsed here is the bound itself, so no accepted text is read in another way
    return F.lit(_instant(text).isoformat(sep=" ")).cast("timestamp_ntz")


@dataclass(frozen=True)
class DateRange:
    lower: Column
    upper: Column


def normalize(req: PageRequest) -> tuple[PageRequest, DateRange]:
    """defaults of the query builder (page <= 0 -> 1, size <= 0 -> 20,
    to = now, from = to - 3 months with the day clamped at month end)."""
    page = req.page if req.page > 0 else C.DEFAULT_PAGE
    size = req.page_size if req.page_size > 0 else C.DEFAULT_PAGE_SIZE
    upper = _ts(req.to_date if req.to_date else req.as_of)
    lower = (_ts(req.from_date) if req.from_date
             else upper - F.make_ym_interval(F.lit(0), F.lit(C.DEFAULT_LOOKBACK_MONTHS)))
    norm = replace(req, page=page, page_size=size, currency=_optional(req.currency),
                   channel=_optional(req.channel))
    return norm, DateRange(lower, upper)


def resolve_customer_id(customers: DataFrame, external_id: str) -> str:
    """Surrogate id of one external id, or CustomerNotFound.

    Reads at most one row (the external id is unique), like the original's
    lookup before the page query.
    """
    rows = customers.filter(F.col("external_id") == external_id).select("id").limit(1).collect()
    if not rows:
        raise CustomerNotFound(external_id)
    return rows[0][0]


def filter_transactions(tx: DataFrame, customer_id: str | None, window: DateRange | None,
                        currency: str | None = None, channel: str | None = None) -> DataFrame:
    """Conjunction of the filters that are present."""
    out = tx
    if customer_id is not None:
        out = out.filter(F.col("customer_id") == customer_id)
    if window is not None:
        out = out.filter((F.col("transaction_date") >= window.lower)
                         & (F.col("transaction_date") <= window.upper))
        if "txn_month" in tx.columns:
            # the store's month partitions: Parquet cannot derive this bound
            # from the date predicate, so it is stated for partition pruning
            out = out.filter(F.col("txn_month").between(F.date_format(window.lower, "yyyy-MM"),
                                                        F.date_format(window.upper, "yyyy-MM")))
    if _optional(currency) is not None:
        out = out.filter(F.col("currency") == currency)
    if _optional(channel) is not None:
        out = out.filter(F.col("source_channel") == channel)
    return out


def newest_first() -> tuple[Column, Column]:
    """O1: newest first, id as the tie-break."""
    return F.col("transaction_date").desc(), F.col("id").desc()
ITEM_COLUMNS = ("external_transaction_id", "transaction_date", "amount", "currency",
                "source_channel", "created_at")


@dataclass
class Page:
    items: DataFrame
    info: DataFrame


def customer_page(tx: DataFrame, customers: DataFrame, req: PageRequest) -> Page:
    """The page request: items (newest first, offset/limit) and page info."""
    check_range(req)
    norm, window = normalize(req)
    cid = resolve_customer_id(customers, norm.customer)
    rows = filter_transactions(tx, cid, window, norm.currency, norm.channel)
    offset = (norm.page - 1) * norm.page_size
    items = (rows.orderBy(*newest_first()).offset(offset).limit(norm.page_size)
             .select(F.lit(norm.customer).alias("customer"), *ITEM_COLUMNS))
    total = rows.agg(F.count(F.lit(1)).alias("total_count"))
    size = F.lit(norm.page_size)
    info = total.select("total_count", F.lit(norm.page).alias("page"),
                        size.alias("page_size"),
                        page_count(F.col("total_count"), size).alias("total_pages"))
    return Page(items, info)


def page_with_total(tx: DataFrame, customers: DataFrame, req: PageRequest) -> DataFrame:
    """Page items each carrying the total, as ``COUNT(*) OVER ()`` would.

    The total is a scalar subquery (evaluated once, then a literal in the
    projection), so no row moves to a single partition and nothing is joined.
    """
    page = customer_page(tx, customers, req)
    return page.items.withColumn("total_count", page.info.select("total_count").scalar())


def page_all_customers(tx: DataFrame, customers: DataFrame, page: int, page_size: int,
                       from_date: str | None, to_date: str | None) -> DataFrame:
    """Page ``page`` of every customer at once.

    ``row_number`` with a rank bound becomes a ``WindowGroupLimit`` that keeps
    only the top (offset + size) rows per customer before the shuffle, so a
    hot customer costs no more than a small one after the map side. The
    per-customer total is a plain aggregate (partial, then final).
    """
    lower = _ts(from_date) if from_date else None
    upper = _ts(to_date) if to_date else None
    rows = tx
    if lower is not None:
        rows = rows.filter(F.col("transaction_date") >= lower)
    if upper is not None:
        rows = rows.filter(F.col("transaction_date") <= upper)
    if "txn_month" in tx.columns:                                    # month pruning, as in filter_transactions
        if lower is not None:
            rows = rows.filter(F.col("txn_month") >= F.date_format(lower, "yyyy-MM"))
        if upper is not None:
            rows = rows.filter(F.col("txn_month") <= F.date_format(upper, "yyyy-MM"))
    page = page if page > 0 else C.DEFAULT_PAGE                     # F9, as for one customer
    page_size = min(page_size, C.MAX_PAGE_SIZE) if page_size > 0 else C.DEFAULT_PAGE_SIZE
    first, last = (page - 1) * page_size + 1, page * page_size
    w = Window.partitionBy("customer_id").orderBy(*newest_first())
    ranked = (rows.withColumn("rn", F.row_number().over(w))
              .filter((F.col("rn") >= first) & (F.col("rn") <= last)))
    totals = rows.groupBy("customer_id").agg(F.count(F.lit(1)).alias("total_count"))
    names = customers.select(F.col("id").alias("customer_id"), F.col("external_id").alias("customer"))
    return (ranked.join(totals, "customer_id").join(names, "customer_id")
            .select("customer", F.col("rn").cast("bigint").alias("rn"), *ITEM_COLUMNS,
                    "total_count"))


def unknown_customers(requested: DataFrame, customers: DataFrame,
                      col: str = "external_id") -> DataFrame:
    """F11 set-wise: requested external ids with no customer row."""
    return (requested.select(F.col(col).alias("external_id")).distinct()
            .join(customers.select("external_id"), "external_id", "left_anti")
            .withColumn("status", F.lit("not_found")))
