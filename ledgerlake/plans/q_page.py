"""Registered page and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paging
from ..sources import tables
from .registry import register

CUSTOMER = "Customer#000000005"
CUSTOMER_KEY = "5"
FROM, TO = "1995-01-01 00:00:00", "2001-08-01 00:00:00"
NOW = "2001-08-01 00:00:00"   # clock for the default three-month lookback

ITEMS = """'{c}' AS customer, external_transaction_id, transaction_date, amount, currency,
       source_channel, created_at"""


def _page_sql(where: str, limit: int, offset: int, customer: str = CUSTOMER) -> str:
    return f"""
SELECT {ITEMS.format(c=customer)} FROM transactions
WHERE customer_id = '{CUSTOMER_KEY}' {where}
ORDER BY transaction_date DESC, id DESC LIMIT {limit} OFFSET {offset}"""


def _tx(spark, sf):
    return tables.transactions(spark, sf)


def _page(spark, sf, **kw):
    return paging.customer_page(_tx(spark, sf), tables.customers(spark, sf),
                                paging.PageRequest(CUSTOMER, **kw))


FILTER_COLS = ["id", "customer_id", "external_transaction_id", "transaction_date", "amount",
               "currency", "source_channel"]


@register("filter_customer", f"""
SELECT {', '.join(FILTER_COLS)} FROM transactions WHERE customer_id = '{CUSTOMER_KEY}'""")
def q_filter_customer(spark, sf):
    cid = paging.resolve_customer_id(tables.customers(spark, sf), CUSTOMER)
    return paging.filter_transactions(_tx(spark, sf), cid, None).select(*FILTER_COLS)


@register("filter_date_range", f"""
SELECT {', '.join(FILTER_COLS)} FROM transactions
WHERE transaction_date >= TIMESTAMP '1998-01-01 00:00:00'
  AND transaction_date <= TIMESTAMP '1998-06-30 00:00:00'""")
def q_filter_date_range(spark, sf):
    rng = paging.DateRange(F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"),
                           F.lit("1998-06-30 00:00:00").cast("timestamp_ntz"))
    return paging.filter_transactions(_tx(spark, sf), None, rng).select(*FILTER_COLS)


@register("filter_default_lookback", f"""
SELECT {', '.join(FILTER_COLS)} FROM transactions
WHERE transaction_date >= TIMESTAMP '{NOW}' - INTERVAL 3 MONTH
  AND transaction_date <= TIMESTAMP '{NOW}'""")
def q_filter_default_lookback(spark, sf):
    _, rng = paging.normalize(paging.PageRequest("", as_of=NOW))
    return paging.filter_transactions(_tx(spark, sf), None, rng).select(*FILTER_COLS)


@register("filter_currency", f"""
SELECT {', '.join(FILTER_COLS)} FROM transactions WHERE currency = 'EUR'""")
def q_filter_currency(spark, sf):
    return paging.filter_transactions(_tx(spark, sf), None, None, currency="EUR") \
        .select(*FILTER_COLS)


@register("filter_channel", f"""
SELECT {', '.join(FILTER_COLS)} FROM transactions WHERE source_channel = 'web'""")
def q_filter_channel(spark, sf):
    return paging.filter_transactions(_tx(spark, sf), None, None, channel="web") \
        .select(*FILTER_COLS)


@register("filter_blank_is_noop", _page_sql(
    f"AND transaction_date BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'", 20, 0))
def q_filter_blank_is_noop(spark, sf):
    return _page(spark, sf, from_date=FROM, to_date=TO, currency="   ", channel="\t").items


@register("customer_page", _page_sql(
    f"AND transaction_date BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'", 5, 0))
def q_customer_page(spark, sf):
    return _page(spark, sf, page=1, page_size=5, from_date=FROM, to_date=TO).items


@register("customer_page_2", _page_sql(
    f"AND transaction_date BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'", 5, 5))
def q_customer_page_2(spark, sf):
    return _page(spark, sf, page=2, page_size=5, from_date=FROM, to_date=TO).items


@register("customer_page_default_window", _page_sql(
    f"AND transaction_date BETWEEN TIMESTAMP '{NOW}' - INTERVAL 3 MONTH AND TIMESTAMP '{NOW}'",
    20, 0))
def q_customer_page_default_window(spark, sf):
    return _page(spark, sf, page=0, page_size=0, as_of=NOW).items


@register("customer_page_filtered", _page_sql(
    f"AND transaction_date BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}' "
    "AND currency = 'CHF' AND source_channel = 'import'", 20, 0))
def q_customer_page_filtered(spark, sf):
    return _page(spark, sf, from_date=FROM, to_date=TO, currency="CHF", channel="import").items


@register("customer_page_clamped", _page_sql(
    f"AND transaction_date BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'", 100, 0))
def q_customer_page_clamped(spark, sf):
    req = paging.clamp_api(paging.PageRequest(CUSTOMER, page=-3, page_size=500,
                                              from_date=FROM, to_date=TO))
    return paging.customer_page(_tx(spark, sf), tables.customers(spark, sf), req).items


@register("page_info", f"""
SELECT count(*) AS total_count, 2 AS page, 5 AS page_size,
       CAST(ceil(count(*) / 5.0) AS BIGINT) AS total_pages
FROM transactions WHERE customer_id = '{CUSTOMER_KEY}'
  AND transaction_date BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'""")
def q_page_info(spark, sf):
    return _page(spark, sf, page=2, page_size=5, from_date=FROM, to_date=TO).info


@register("page_with_total", f"""
SELECT *, (SELECT count(*) FROM transactions WHERE customer_id = '{CUSTOMER_KEY}'
           AND transaction_date BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}') AS total_count
FROM ({_page_sql(f"AND transaction_date BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'", 5, 0)})""")
def q_page_with_total(spark, sf):
    return paging.page_with_total(_tx(spark, sf), tables.customers(spark, sf),
                                  paging.PageRequest(CUSTOMER, 1, 5, FROM, TO))


@register("page_all_customers", f"""
SELECT customer, rn, external_transaction_id, transaction_date, amount, currency,
       source_channel, created_at, total_count
FROM (SELECT c.external_id AS customer, t.*,
             row_number() OVER (PARTITION BY t.customer_id
                                ORDER BY t.transaction_date DESC, t.id DESC) AS rn,
             count(*) OVER (PARTITION BY t.customer_id) AS total_count
      FROM transactions t JOIN customers c ON c.id = t.customer_id
      WHERE t.transaction_date BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}')
WHERE rn BETWEEN 4 AND 6""")
def q_page_all_customers(spark, sf):
    return paging.page_all_customers(_tx(spark, sf), tables.customers(spark, sf), 2, 3, FROM, TO)


@register("unknown_customers", """
SELECT DISTINCT customerId AS external_id, 'not_found' AS status
FROM (SELECT customerId FROM raw_transactions UNION ALL SELECT customerId FROM raw_events)
WHERE customerId NOT IN (SELECT external_id FROM customers)""")
def q_unknown_customers(spark, sf):
    req = tables.raw_transactions(spark, sf).select("customerId") \
        .unionByName(tables.raw_events(spark, sf).select("customerId"))
    return paging.unknown_customers(req, tables.customers(spark, sf), "customerId")
