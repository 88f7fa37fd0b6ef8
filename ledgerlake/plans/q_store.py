"""Registered queries over a ledger with commits: replay, compaction, id index, summaries, seek pages, audits.

The ledger is written from the whole ``transactions`` and ``customers`` views in
three labels. One of them is loaded with wrong amounts first, folded into a
compacted run with another, and then replayed with the right rows, so every
query below has to resolve a replaced label inside a compacted run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, id_index, paging, summaries
from ..session import scratch_path
from ..sources import store, tables
from .q_page import CUSTOMER, CUSTOMER_KEY, FROM, TO, _page_sql
from .registry import register

_LEDGERS: dict[tuple[str, str, str], str] = {}
COLUMNS = ", ".join(tables.TRANSACTION_COLUMNS)
IN_RANGE = f"AND transaction_date BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"


def _key(df):
    return F.substring(df["external_transaction_id"], 5, 10).cast("bigint")


def ledger(spark, sf):
    """A snapshot of the ledger over the test tables; written once a session."""
    at = (spark.sparkContext.applicationId, sf, "ledger")
    if at not in _LEDGERS:
        root = scratch_path(spark, "ledger")
        tx, cu = tables.transactions(spark, sf), tables.customers(spark, sf)
        part = [tx.where(_key(tx) % 3 == i) for i in range(3)]
        none = cu.where("false")
        store.load_label(part[0], cu, root, "h0")
        store.load_label(part[1].withColumn("amount", (F.col("amount") * 2).cast("decimal(18,4)")), none, root, "h1")
        store.compact(spark, root)
        store.load_label(part[1], none, root, "h1")
        store.load_label(part[2], none, root, "h2")
        store.vacuum(spark, root)
        _LEDGERS[at] = root
    return store.snapshot(spark, _LEDGERS[at])


def faulty_ledger(spark, sf):
    """A ledger whose second label repeats ids of the first and of itself and names unknown customers."""
    at = (spark.sparkContext.applicationId, sf, "faulty")
    if at not in _LEDGERS:
        root = scratch_path(spark, "faulty")
        tx, cu = tables.transactions(spark, sf), tables.customers(spark, sf)
        store.load_label(tx.where(_key(tx) % 3 == 0), cu.where(F.col("id").cast("bigint") % 5 != 0), root, "good")
        once, twice = tx.where(_key(tx) % 9 == 0), tx.where(_key(tx) % 9 == 1)
        store.load_label(once.unionByName(twice).unionByName(twice), cu.where("false"), root, "bad")
        _LEDGERS[at] = root
    return store.snapshot(spark, _LEDGERS[at])


@register("ledger_transactions", f"SELECT {COLUMNS} FROM transactions")
def q_ledger_transactions(spark, sf):
    return ledger(spark, sf).read("transactions").select(*tables.TRANSACTION_COLUMNS)


@register("ledger_existing_ids", """
SELECT DISTINCT transactionId AS external_transaction_id FROM raw_transactions
WHERE transactionId IN (SELECT external_transaction_id FROM transactions)""")
def q_ledger_existing_ids(spark, sf):
    return id_index.stored_ids(tables.raw_transactions(spark, sf), "transactionId", ledger(spark, sf))


def _request(**kw):
    return paging.PageRequest(CUSTOMER, from_date=FROM, to_date=TO, **kw)


@register("ledger_customer", f"SELECT {COLUMNS} FROM transactions WHERE customer_id = '{CUSTOMER_KEY}'")
def q_ledger_customer(spark, sf):
    return store.customer_transactions(ledger(spark, sf), CUSTOMER_KEY).select(*tables.TRANSACTION_COLUMNS)


@register("ledger_page_2", _page_sql(IN_RANGE, 5, 5))
def q_ledger_page_2(spark, sf):
    return summaries.seek_page(ledger(spark, sf), _request(page=2, page_size=5))


@register("ledger_page_deep", _page_sql(IN_RANGE, 1, 6))
def q_ledger_page_deep(spark, sf):
    return summaries.seek_page(ledger(spark, sf), _request(page=7, page_size=1))


@register("ledger_page_filtered", _page_sql(IN_RANGE + " AND currency = 'CHF'", 20, 0))
def q_ledger_page_filtered(spark, sf):
    return summaries.seek_page(ledger(spark, sf), _request(page=1, page_size=20, currency="CHF"))


@register("ledger_page_after", _page_sql(IN_RANGE, 5, 5))
def q_ledger_page_after(spark, sf):
    snap = ledger(spark, sf)
    before = summaries.page_after(snap, _request(page_size=5)).collect()      # one page of five rows
    last = before[-1] if before else None
    after = (str(last.transaction_date), last.id) if last else None
    return summaries.page_after(snap, _request(page_size=5), after).drop("id")


@register("ledger_page_info", f"""
SELECT count(*) AS total_count, 2 AS page, 5 AS page_size, CAST(ceil(count(*) / 5.0) AS BIGINT) AS total_pages
FROM transactions WHERE customer_id = '{CUSTOMER_KEY}' {IN_RANGE}""")
def q_ledger_page_info(spark, sf):
    return summaries.page_total(ledger(spark, sf), _request(page=2, page_size=5))


@register("ledger_stats_total", """
SELECT count(*) AS total_transactions, count(DISTINCT customer_id) AS unique_customers,
       min(transaction_date) AS oldest_transaction, max(transaction_date) AS newest_transaction
FROM transactions""")
def q_ledger_stats_total(spark, sf):
    return summaries.stats_total(ledger(spark, sf))


SUMS = "count(*) AS txn_count, CAST(coalesce(sum(amount), 0) AS DECIMAL(38,4)) AS total_amount"


@register("ledger_stats_by_currency", f"SELECT currency, {SUMS} FROM transactions GROUP BY currency")
def q_ledger_stats_by_currency(spark, sf):
    return summaries.stats_by_currency(ledger(spark, sf))


@register("ledger_stats_by_channel", f"SELECT source_channel AS channel, {SUMS} FROM transactions GROUP BY source_channel")
def q_ledger_stats_by_channel(spark, sf):
    return summaries.stats_by_channel(ledger(spark, sf))


@register("ledger_stats_by_customer_currency", f"""
SELECT c.external_id AS customer, t.currency, {SUMS}
FROM transactions t JOIN customers c ON c.id = t.customer_id GROUP BY c.external_id, t.currency""")
def q_ledger_stats_by_customer_currency(spark, sf):
    return summaries.stats_by_customer(ledger(spark, sf), "currency", "currency")


@register("ledger_stats_by_customer_channel", f"""
SELECT c.external_id AS customer, t.source_channel AS channel, {SUMS}
FROM transactions t JOIN customers c ON c.id = t.customer_id GROUP BY c.external_id, t.source_channel""")
def q_ledger_stats_by_customer_channel(spark, sf):
    return summaries.stats_by_customer(ledger(spark, sf), "source_channel", "channel")


KEY = "CAST(substring(external_transaction_id, 5, 10) AS BIGINT)"


@register("ledger_audit_label_ids", f"""
SELECT external_transaction_id, CASE WHEN {KEY} % 9 = 1 THEN 2 ELSE 1 END AS occurrences, {KEY} % 3 = 0 AS elsewhere
FROM transactions WHERE {KEY} % 9 IN (0, 1)""")
def q_ledger_audit_label_ids(spark, sf):
    return audit.label_duplicates(faulty_ledger(spark, sf), "bad")


@register("ledger_audit_label_orphans", f"""
SELECT customer_id, sum(CASE WHEN {KEY} % 9 = 1 THEN 2 ELSE 1 END)::BIGINT AS transactions
FROM transactions WHERE {KEY} % 9 IN (0, 1) AND CAST(customer_id AS BIGINT) % 5 = 0 GROUP BY customer_id""")
def q_ledger_audit_label_orphans(spark, sf):
    return audit.label_orphans(faulty_ledger(spark, sf), "bad")
