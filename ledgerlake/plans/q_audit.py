"""Registered audit queries."""

from __future__ import annotations

from ..operators import audit
from ..sources import tables
from .registry import register

TX_NOT_NULL = ("id", "customer_id", "external_transaction_id", "transaction_date", "amount",
               "currency", "source_channel", "created_at")


@register("audit_unique_txn", """
SELECT external_transaction_id, count(*) AS occurrences FROM transactions
GROUP BY 1 HAVING count(*) > 1""")
def q_audit_unique_txn(spark, sf):
    return audit.duplicate_keys(tables.transactions(spark, sf), "external_transaction_id")


@register("audit_unique_customer", """
SELECT external_id, count(*) AS occurrences FROM customers GROUP BY 1 HAVING count(*) > 1""")
def q_audit_unique_customer(spark, sf):
    return audit.duplicate_keys(tables.customers(spark, sf), "external_id")


@register("audit_orphans", """
SELECT t.* FROM transactions t WHERE t.customer_id NOT IN (SELECT id FROM customers)""")
def q_audit_orphans(spark, sf):
    return audit.orphans(tables.transactions(spark, sf), tables.customers(spark, sf))


@register("audit_nulls", "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_nulls" for c in TX_NOT_NULL)
    + " FROM transactions")
def q_audit_nulls(spark, sf):
    return audit.null_counts(tables.transactions(spark, sf), TX_NOT_NULL)


@register("audit_widths", """
SELECT count(*) FILTER (WHERE length(external_transaction_id) > 255) AS txn_id_too_long,
       count(*) FILTER (WHERE length(currency) <> 3) AS currency_bad_length,
       count(*) FILTER (WHERE length(source_channel) > 100) AS channel_too_long,
       count(*) FILTER (WHERE abs(amount) >= 100000000000000) AS amount_out_of_precision,
       count(*) FILTER (WHERE amount <> round(amount, 4)) AS amount_beyond_scale
FROM transactions""")
def q_audit_widths(spark, sf):
    return audit.width_violations(tables.transactions(spark, sf))


CUSTOMER_NOT_NULL = ("id", "external_id", "created_at")


@register("audit_customer_nulls", "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_nulls" for c in CUSTOMER_NOT_NULL) + " FROM customers")
def q_audit_customer_nulls(spark, sf):
    return audit.null_counts(tables.customers(spark, sf), CUSTOMER_NOT_NULL)


@register("audit_customer_widths", """
SELECT count(*) FILTER (WHERE length(external_id) > 100) AS customer_id_too_long FROM customers""")
def q_audit_customer_widths(spark, sf):
    return audit.customer_width_violations(tables.customers(spark, sf))
