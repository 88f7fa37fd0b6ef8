"""Replays with corrected rows, labels as text, dates in more forms, wide and upper-case files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.parsing import parse_timestamp, utc_wall_clock
from ledgerlake.plans.ingest import ingest_text_batch, run_ingest
from ledgerlake.sources import files, store
from ledgerlake.streaming.ingest_stream import ingest_stream

AS_OF = "2024-06-01 00:00:00"
COLS = ["row_key", "customerId", "transactionId", "transactionDate", "amount", "currency", "sourceChannel"]


def rows(spark, *rs):
    return spark.createDataFrame([(i, c, t, "2024-05-01T00:00:00Z", a, "USD", "web") for i, (c, t, a) in enumerate(rs)],
                                 "row_key bigint, customerId string, transactionId string, transactionDate string, "
                                 "amount string, currency string, sourceChannel string")


def ids(df, col="external_transaction_id"):
    return sorted(r[0] for r in df.select(col).collect())


def test_replay_with_corrected_rows(spark, tmp_dir):
    run_ingest(rows(spark, ("C1", "T1", "1"), ("C1", "T2", "2")), tmp_dir, "b1", AS_OF)
    run_ingest(rows(spark, ("C1", "T3", "1")), tmp_dir, "b2", AS_OF)
    run_ingest(rows(spark, ("C2", "T1", "1"), ("C1", "T2", "0")), tmp_dir, "b1", AS_OF)
    assert ids(store.read_transactions(spark, tmp_dir)) == ["T1", "T3"]
    assert ids(store.read_customers(spark, tmp_dir), "external_id") == ["C1", "C2"]      # b2 refers to C1
    run_ingest(rows(spark, ("C2", "T1", "0")), tmp_dir, "b1", AS_OF)                       # nothing is left of b1
    assert ids(store.read_transactions(spark, tmp_dir)) == ["T3"]


def test_labels_are_text(spark, tmp_dir):
    run_ingest(rows(spark, ("C1", "T1", "1")), tmp_dir, "2024-06-01", AS_OF)
    run_ingest(rows(spark, ("C1", "T2", "1")), tmp_dir, "2024-06-01-late", AS_OF)
    run_ingest(rows(spark, ("C1", "T3", "1")), tmp_dir, "01", AS_OF)
    run_ingest(rows(spark, ("C1", "T3", "1"), ("C1", "T4", "1")), tmp_dir, "1", AS_OF)
    run_ingest(rows(spark, ("C1", "T5", "1")), tmp_dir, "a/b:c=d", AS_OF)
    assert ids(store.read_transactions(spark, tmp_dir)) == ["T1", "T2", "T3", "T4", "T5"]
    assert "a/b:c=d" in ids(store.read_transactions(spark, tmp_dir), "ingest_batch")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_date_forms_in_any_zone(spark, zone):
    forms = {
        "1/15/2024 10:00 AM": (10, 0), "1/15/2024 10:00 PM": (22, 0), "1/15/2024 12:05 am": (0, 5), "2024/01/15": (0, 0),
        "2024-1-15": (0, 0), "15 Jan 2024": (0, 0), "15 January 2024 9:30": (9, 30), "2024-01-15T05:00:00-05:00": (10, 0),
        "1/15/2024 13:00 PM": None, "15 Foo 2024": None, "2024-13-01": None}
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(k,) for k in forms], "s string").select("s", parse_timestamp(F.col("s")).alias("t"))
        got = {r.s: r.t for r in df.collect()}
        hours = spark.createDataFrame([("2023-11-05T05:30Z",), ("2023-11-05T06:30Z",)], "s string")
        assert [r[0].hour for r in hours.select(parse_timestamp(F.col("s"))).collect()] == [5, 6]
        assert utc_wall_clock(F.current_timestamp()) is not None
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert got == {k: v and dt.datetime(2024, 1, 15, *v) for k, v in forms.items()}


def test_wide_csv_any_subset(spark, tmp_path):
    names = [f"x{i}" for i in range(90)] + ["customerId", "amount"]
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + ",".join(str(i) for i in range(92)) + "\n")
    got = files.read_csv_by_header(spark, str(tmp_path)).select("customerId", "amount", "currency").collect()
    assert [tuple(r) for r in got] == [("90", "91", "")]


def test_stream_takes_any_case(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    head = "customerId,transactionId,transactionDate,amount,currency,sourceChannel\n"
    (src / "a.csv").write_text(head + "C1,T1,2024-05-01,1,USD,web\n")
    (src / "b.CSV").write_text(head + "C1,T2,2024-05-01,1,USD,web\n")
    ingest_stream(spark, str(src), str(tmp_path / "root"), str(tmp_path / "ck"), as_of=AS_OF)
    assert ids(store.read_transactions(spark, str(tmp_path / "root"))) == ["T1", "T2"]


def test_invalid_and_null_ids_have_keys_of_their_own(spark):
    df = spark.range(2000).select(
        F.col("id").alias("row_key"), F.lit("C1").alias("customerId"),
        F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.lit("T")).alias("transactionId"),
        F.lit("2024-05-01").alias("transactionDate"), F.lit("1").alias("amount"), F.lit("USD").alias("currency"),
        F.lit("web").alias("sourceChannel"))
    customers = spark.createDataFrame([], store.CUSTOMER_SCHEMA)
    got = {r.status: r["count"] for r in ingest_text_batch(df, None, customers, AS_OF).classified.groupBy("status").count().collect()}
    assert got == {"accepted": 1, "duplicate": 665, "invalid": 1334}
