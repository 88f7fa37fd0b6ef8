"""Page queries and summary statistics."""

import datetime as dt
from decimal import Decimal

import pytest

from ledgerlake.operators import paging, stats
from ledgerlake.sources import store


def tables(spark):
    d = dt.datetime
    tx = spark.createDataFrame([
        ("a", "k1", "T1", d(2024, 5, 1), Decimal("10.5"), "USD", "web", d(2024, 5, 1)),
        ("b", "k1", "T2", d(2024, 5, 2), Decimal("20"), "EUR", "pos", d(2024, 5, 2)),
        ("c", "k1", "T3", d(2024, 5, 2), Decimal("30"), "USD", "web", d(2024, 5, 2)),
        ("d", "k2", "T4", d(2024, 1, 1), Decimal("1"), "USD", "api", d(2024, 1, 1)),
        ("e", "k1", "T5", d(2023, 1, 1), Decimal("5"), "USD", "web", d(2023, 1, 1)),
    ], store.TRANSACTION_SCHEMA)
    cu = spark.createDataFrame([("k1", "CUST-001", d(2023, 1, 1)), ("k2", "CUST-002", None),
                                ("k3", "CUST-003", None)], store.CUSTOMER_SCHEMA)
    return tx, cu


def ids(df):
    return [r.external_transaction_id for r in df.collect()]


def test_page_newest_first_with_tie_break(spark):
    tx, cu = tables(spark)
    p = paging.customer_page(tx, cu, paging.PageRequest("CUST-001", 1, 2, as_of="2024-06-01"))
    assert ids(p.items) == ["T3", "T2"]
    info = p.info.first()
    assert (info.total_count, info.total_pages) == (3, 2)


def test_page_past_end_keeps_true_total(spark):
    tx, cu = tables(spark)
    p = paging.customer_page(tx, cu, paging.PageRequest("CUST-001", 9, 2, as_of="2024-06-01"))
    assert ids(p.items) == []
    assert p.info.first().total_count == 3


def test_default_lookback_excludes_older_rows(spark):
    tx, cu = tables(spark)
    p = paging.customer_page(tx, cu, paging.PageRequest("CUST-001", as_of="2024-06-01"))
    assert sorted(ids(p.items)) == ["T1", "T2", "T3"]   # T5 is older than 3 months


def test_filters_and_blank_filters(spark):
    tx, cu = tables(spark)
    req = paging.PageRequest("CUST-001", from_date="2020-01-01", to_date="2024-12-31",
                             currency="USD", channel=" ")
    assert sorted(ids(paging.customer_page(tx, cu, req).items)) == ["T1", "T3", "T5"]


def test_unknown_customer_and_bad_range(spark):
    tx, cu = tables(spark)
    with pytest.raises(paging.CustomerNotFound):
        paging.customer_page(tx, cu, paging.PageRequest("NOPE", as_of="2024-06-01"))
    with pytest.raises(ValueError):
        paging.customer_page(tx, cu, paging.PageRequest("CUST-001", from_date="2024-02-01",
                                                        to_date="2024-01-01"))
    empty = paging.customer_page(tx, cu, paging.PageRequest("CUST-003", as_of="2024-06-01"))
    assert empty.info.first().total_count == 0


def test_range_check_compares_instants():
    paging.check_range(paging.PageRequest("x", from_date="2024-01-01T10:00:00+05:00",
                                          to_date="2024-01-01 06:00"))
    with pytest.raises(ValueError):
        paging.check_range(paging.PageRequest("x", from_date="2024-01-02",
                                              to_date="2024-01-01T23:59:59Z"))


def test_clamp():
    r = paging.clamp_api(paging.PageRequest("x", page=0, page_size=1000))
    assert (r.page, r.page_size) == (1, 100)


def test_page_all_customers(spark):
    tx, cu = tables(spark)
    got = paging.page_all_customers(tx, cu, 1, 2, None, None).collect()
    assert sorted((r.customer, r.rn, r.external_transaction_id) for r in got) == [
        ("CUST-001", 1, "T3"), ("CUST-001", 2, "T2"), ("CUST-002", 1, "T4")]


def test_summary(spark):
    tx, cu = tables(spark)
    s = stats.summary(tx, cu, include_customer_breakdowns=True)
    t = s.total.first()
    assert (t.total_transactions, t.unique_customers) == (5, 2)
    assert {r.currency: (r.txn_count, r.total_amount) for r in s.by_currency.collect()} == {
        "EUR": (1, Decimal("20.0000")), "USD": (4, Decimal("46.5000"))}
    cc = [(r.customer, r.currency, r.txn_count) for r in s.by_customer_currency.collect()]
    assert cc == [("CUST-001", "EUR", 1), ("CUST-001", "USD", 3), ("CUST-002", "USD", 1)]
    assert s.by_customer_channel.count() == 3


def test_summary_empty_table(spark):
    tx, cu = tables(spark)
    t = stats.stats_total(tx.limit(0)).first()
    assert (t.total_transactions, t.oldest_transaction) == (0, None)
    assert stats.stats_by_currency(tx.limit(0)).count() == 0


def test_grouping_sets_match_separate_aggregates(spark):
    tx, cu = tables(spark)
    gs = stats.stats_grouping_sets(tx, cu, True)
    assert gs.filter("grain = 'currency'").count() == 2
    assert gs.filter("grain = 'customer_channel'").count() == 3
    assert stats.stats_grouping_sets(tx, cu, False).filter("customer IS NOT NULL").count() == 0


def test_store_page_prunes_month_partitions(spark, capsys):
    from ledgerlake.plans.ingest import run_ingest
    from ledgerlake.session import scratch_path
    rows = [(i + 1, i + 1, "f.csv", "CUST-1", f"T{i}", f"2024-0{1 + i % 5}-10T10:00:00Z", "5",
             "USD", "web") for i in range(50)]
    cols = ("row_number long, row_key long, source_file string, customerId string, "
            "transactionId string, transactionDate string, amount string, currency string, "
            "sourceChannel string")
    root = scratch_path(spark, "page-store")
    run_ingest(spark.createDataFrame(rows, cols), root, "b1", "2024-06-01 00:00:00")
    tx = store.read_transactions(spark, root, with_partitions=True)
    cu = store.read_customers(spark, root)
    req = paging.PageRequest("CUST-1", 1, 100, "2024-02-01", "2024-03-31")
    page = paging.customer_page(tx, cu, req)
    assert page.info.first().total_count == 20
    capsys.readouterr()
    page.items.explain(mode="formatted")
    scan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(txn_month" in scan
    pushed = scan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "EqualTo(customer_id," in pushed and "GreaterThanOrEqual(transaction_date," in pushed


def test_stats_document(spark):
    tx, cu = tables(spark)
    doc = stats.stats_document(tx).first()
    assert (doc.total_transactions, doc.unique_customers) == (5, 2)
    assert [(c.currency, c.txn_count) for c in doc.by_currency] == [("EUR", 1), ("USD", 4)]
    assert [c.channel for c in doc.by_channel] == ["api", "pos", "web"]
