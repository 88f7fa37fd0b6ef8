"""Registered summary-statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..sources import tables
from .registry import register

AS_OF = "2002-01-01 00:00:00"


@register("stats_total", """
SELECT count(*) AS total_transactions, count(DISTINCT customer_id) AS unique_customers,
       min(transaction_date) AS oldest_transaction, max(transaction_date) AS newest_transaction
FROM transactions""")
def q_stats_total(spark, sf):
    return stats.stats_total(tables.transactions(spark, sf))


@register("stats_total_empty", f"""
SELECT count(*) AS total_transactions, count(DISTINCT customer_id) AS unique_customers,
       min(transaction_date) AS oldest_transaction, max(transaction_date) AS newest_transaction
FROM transactions WHERE transaction_date > TIMESTAMP '{AS_OF}'""")
def q_stats_total_empty(spark, sf):
    tx = tables.transactions(spark, sf)
    return stats.stats_total(tx.filter(F.col("transaction_date") >
                                       F.lit(AS_OF).cast("timestamp_ntz")))


@register("stats_by_currency", """
SELECT currency, count(*) AS txn_count,
       CAST(coalesce(sum(amount), 0) AS DECIMAL(38,4)) AS total_amount
FROM transactions GROUP BY currency ORDER BY currency""")
def q_stats_by_currency(spark, sf):
    return stats.stats_by_currency(tables.transactions(spark, sf))


@register("stats_by_channel", """
SELECT source_channel AS channel, count(*) AS txn_count,
       CAST(coalesce(sum(amount), 0) AS DECIMAL(38,4)) AS total_amount
FROM transactions GROUP BY source_channel ORDER BY source_channel""")
def q_stats_by_channel(spark, sf):
    return stats.stats_by_channel(tables.transactions(spark, sf))


@register("stats_by_customer_currency", """
SELECT c.external_id AS customer, t.currency, count(*) AS txn_count,
       CAST(coalesce(sum(t.amount), 0) AS DECIMAL(38,4)) AS total_amount
FROM transactions t JOIN customers c ON c.id = t.customer_id
GROUP BY c.external_id, t.currency ORDER BY 1, 2""")
def q_stats_by_customer_currency(spark, sf):
    return stats.stats_by_customer_currency(tables.transactions(spark, sf),
                                            tables.customers(spark, sf))


@register("stats_by_customer_channel", """
SELECT c.external_id AS customer, t.source_channel AS channel, count(*) AS txn_count,
       CAST(coalesce(sum(t.amount), 0) AS DECIMAL(38,4)) AS total_amount
FROM transactions t JOIN customers c ON c.id = t.customer_id
GROUP BY c.external_id, t.source_channel ORDER BY 1, 2""")
def q_stats_by_customer_channel(spark, sf):
    return stats.stats_by_customer_channel(tables.transactions(spark, sf),
                                           tables.customers(spark, sf))


@register("stats_grouping_sets", """
SELECT 'currency' AS grain, CAST(NULL AS VARCHAR) AS customer, currency,
       CAST(NULL AS VARCHAR) AS channel, count(*) AS txn_count,
       CAST(coalesce(sum(amount), 0) AS DECIMAL(38,4)) AS total_amount
FROM transactions GROUP BY currency
UNION ALL
SELECT 'channel', NULL, NULL, source_channel, count(*),
       CAST(coalesce(sum(amount), 0) AS DECIMAL(38,4))
FROM transactions GROUP BY source_channel
UNION ALL
SELECT 'customer_currency', c.external_id, t.currency, NULL, count(*),
       CAST(coalesce(sum(t.amount), 0) AS DECIMAL(38,4))
FROM transactions t JOIN customers c ON c.id = t.customer_id GROUP BY c.external_id, t.currency
UNION ALL
SELECT 'customer_channel', c.external_id, NULL, t.source_channel, count(*),
       CAST(coalesce(sum(t.amount), 0) AS DECIMAL(38,4))
FROM transactions t JOIN customers c ON c.id = t.customer_id
GROUP BY c.external_id, t.source_channel""")
def q_stats_grouping_sets(spark, sf):
    return stats.stats_grouping_sets(tables.transactions(spark, sf),
                                     tables.customers(spark, sf), True)


@register("stats_document")
def q_stats_document(spark, sf):
    return stats.stats_document(tables.transactions(spark, sf))


@register("stats_document_text", """
SELECT (SELECT count(*) FROM transactions) AS total_transactions,
       (SELECT string_agg(currency || ':' || n || ':' || total, ',' ORDER BY currency)
        FROM (SELECT currency, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,4)) AS total FROM transactions GROUP BY 1))
         AS by_currency,
       (SELECT string_agg(channel || ':' || n || ':' || total, ',' ORDER BY channel)
        FROM (SELECT source_channel AS channel, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,4)) AS total
              FROM transactions GROUP BY 1)) AS by_channel""")
def q_stats_document_text(spark, sf):
    # A9 as text, so that the nested lists can be compared
    def text(lists, key):
        return F.array_join(F.transform(lists, lambda e: F.concat_ws(
            ":", e[key], e["txn_count"].cast("string"), e["total_amount"].cast("string"))), ",").alias(lists)
    doc = stats.stats_document(tables.transactions(spark, sf))
    return doc.select("total_transactions", text("by_currency", "currency"), text("by_channel", "channel"))
