"""Integrity audits find planted violations."""

import datetime as dt
from decimal import Decimal

from ledgerlake.operators import audit
from ledgerlake.sources import store


def test_audits_report_violations(spark):
    d = dt.datetime(2024, 1, 1)
    tx = spark.createDataFrame([
        ("a", "k1", "T1", d, Decimal("1"), "USD", "web", d),
        ("b", "k1", "T1", d, Decimal("2"), "USD", "web", d),         # duplicate id
        ("c", "k9", "T3", d, Decimal("3"), "US", "web", d),          # orphan, bad currency
        ("d", "k1", "T4", None, Decimal("4"), "USD", "w" * 101, d),  # null date, long channel
    ], store.TRANSACTION_SCHEMA)
    cu = spark.createDataFrame([("k1", "CUST-1", d), ("k2", "CUST-1", d)],
                               store.CUSTOMER_SCHEMA)
    assert [tuple(r) for r in audit.duplicate_keys(tx, "external_transaction_id").collect()] \
        == [("T1", 2)]
    assert [tuple(r) for r in audit.duplicate_keys(cu, "external_id").collect()] == [("CUST-1", 2)]
    assert [r.id for r in audit.orphans(tx, cu).collect()] == ["c"]
    nulls = audit.null_counts(tx, ("transaction_date", "amount")).first()
    assert (nulls.transaction_date_nulls, nulls.amount_nulls) == (1, 0)
    w = audit.width_violations(tx).first()
    assert (w.currency_bad_length, w.channel_too_long, w.txn_id_too_long) == (1, 1, 0)
