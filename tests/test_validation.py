"""Rule cases of the original validators, plus the text grammars."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import parsing
from ledgerlake.functions.rules import error_codes, validate_text_rows, validate_typed_rows

AS_OF = "2024-06-01 12:00:00"
FIELDS = ("customerId", "transactionId", "transactionDate", "amount", "currency", "sourceChannel")
VALID = ("CUST-0000000000001", "TXN-" + "a" * 32, "2024-06-01T11:55:00.1234567Z", "42.75",
         "USD", "web")


def codes_csv(spark, **changes):
    row = dict(zip(FIELDS, VALID)) | changes
    df = spark.createDataFrame([tuple(row[f] for f in FIELDS)], list(FIELDS))
    return validate_text_rows(df, AS_OF).select(error_codes().alias("c")).first()["c"]


def codes_json(spark, **changes):
    row = {"customerId": VALID[0], "transactionId": VALID[1],
           "txn_date": dt.datetime(2024, 6, 1, 11, 55), "txn_amount": Decimal("42.75"),
           "currency": "USD", "sourceChannel": "web"} | changes
    schema = ("customerId string, transactionId string, txn_date timestamp_ntz, "
              "txn_amount decimal(38,10), currency string, sourceChannel string")
    df = spark.createDataFrame([tuple(row.values())], schema)
    return validate_typed_rows(df, AS_OF).select(error_codes().alias("c")).first()["c"]


@pytest.mark.parametrize("change,expected", [
    ({}, ""),
    ({"amount": "0"}, "amt_pos"),
    ({"currency": "usd"}, "cur_fmt"),
    ({"transactionDate": "2024-06-01T12:00:01Z"}, "date_future"),
    ({"sourceChannel": "desk"}, "chan_set"),
    ({"transactionDate": "2013-06-01T12:00:00Z"}, "date_old"),
    ({"transactionDate": ""}, "date_empty,date_bad,date_future,date_old"),
    ({"amount": "1e3"}, "amt_bad,amt_pos,amt_max"),
    ({"currency": ""}, "cur_empty,cur_len,cur_fmt"),
    ({"customerId": "\t"}, "cust_empty"),
    ({"customerId": "C" * 101}, "cust_len"),
    ({"sourceChannel": "WEB"}, "chan_set"),
    ({"customerId": "C" * 99 + "\U0001F600"}, "cust_len"),     # 101 UTF-16 units
    ({"customerId": "C" * 98 + "\U0001F600"}, ""),             # 100 UTF-16 units
    ({"currency": "US\U0001F600"}, "cur_len,cur_fmt"),
])
def test_csv_rules(spark, change, expected):
    assert codes_csv(spark, **change) == expected


@pytest.mark.parametrize("change,expected", [
    ({}, ""),
    ({"customerId": ""}, "cust_empty"),
    ({"txn_amount": Decimal(0)}, "amt_pos"),
    ({"txn_amount": Decimal(-1)}, "amt_pos"),
    ({"currency": "usd"}, "cur_fmt"),
    ({"currency": "USDD"}, "cur_len,cur_fmt"),
    ({"txn_date": dt.datetime(2024, 6, 1, 12, 0, 1)}, "date_future"),
    ({"txn_date": dt.datetime(2013, 6, 1, 12, 0)}, "date_old"),
    ({"sourceChannel": "desk"}, "chan_set"),
    ({"txn_date": None}, "date_empty,date_old"),
    ({"txn_amount": None}, "amt_pos"),
])
def test_json_rules(spark, change, expected):
    assert codes_json(spark, **change) == expected


def test_ten_year_bound_is_inclusive(spark):
    assert codes_csv(spark, transactionDate="2014-06-01T12:00:00Z") == ""
    assert codes_csv(spark, transactionDate="2014-06-01T11:59:59Z") == "date_old"
    assert codes_csv(spark, transactionDate="2024-06-01T12:00:00Z") == ""


def _one(spark, expr, text):
    df = spark.createDataFrame([(text,)], "s string")
    return df.select(expr(F.col("s")).alias("v")).first()["v"]


@pytest.mark.parametrize("text,value", [
    ("42.75", "42.75"), (" 1,234.5 ", "1234.5"), ("5.", "5"), (".5", "0.5"), ("+7", "7"),
    ("7-", "-7"), ("-0.00004", "-0.00004"), ("1e3", None), ("abc", None), ("", None),
    ("$5", None), ("+5-", None), (".", None),
])
def test_amount_grammar(spark, text, value):
    got = _one(spark, parsing.parse_amount, text)
    assert (None if got is None else format(got.normalize(), "f")) == value


@pytest.mark.parametrize("text,value", [
    ("2024-01-15T10:00:00Z", dt.datetime(2024, 1, 15, 10)),
    ("2024-01-15 10:00", dt.datetime(2024, 1, 15, 10)),
    ("2024-01-15", dt.datetime(2024, 1, 15)),
    ("2024-01-15T10:00:00+05:30", dt.datetime(2024, 1, 15, 4, 30)),
    ("2024-01-15T10:00:00-0200", dt.datetime(2024, 1, 15, 12)),
    ("2024-01-15T10:00:00.1234567Z", dt.datetime(2024, 1, 15, 10, 0, 0, 123456)),
    ("01/15/2024", dt.datetime(2024, 1, 15)),
    ("1/5/2024 7:30", dt.datetime(2024, 1, 5, 7, 30)),
    ("Mon, 15 Jan 2024 10:00:00 GMT", dt.datetime(2024, 1, 15, 10)),
    ("2024", None), ("12:30", None), ("2024-02-30", None), ("13/01/2024", None),
    ("not-a-date", None),
])
def test_timestamp_grammar(spark, text, value):
    assert _one(spark, parsing.parse_timestamp, text) == value


def test_scale4_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame([("0.00005",), ("-0.00005",), ("0.00004",)], "s string")
    got = [r[0] for r in df.select(parsing.to_stored_amount(parsing.parse_amount(F.col("s"))))
           .collect()]
    assert got == [Decimal("0.0001"), Decimal("-0.0001"), Decimal("0.0000")]


def test_page_count(spark):
    df = spark.createDataFrame([(0, 20), (1, 20), (20, 20), (21, 20), (5, 0)], "n long, s int")
    got = [r[0] for r in df.select(parsing.page_count(F.col("n"), F.col("s"))).collect()]
    assert got == [0, 1, 1, 2, 0]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_parsing_ignores_session_zone(spark, zone):
    texts = ["2024-07-01 12:00", "2024-01-15T10:00:00+05:30", "01/15/2024 10:00",
             "Mon, 15 Jan 2024 10:00:00 GMT"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    expr = parsing.parse_timestamp(F.col("s"))
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = [r[0] for r in df.select(expr).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [dt.datetime(2024, 7, 1, 12), dt.datetime(2024, 1, 15, 4, 30),
                   dt.datetime(2024, 1, 15, 10), dt.datetime(2024, 1, 15, 10)]


def test_short_ways_equal_the_long_ones(spark):
    """Plain texts skip patterns and encoding; each result is that of the long way."""
    texts = [None, "", " ", "\t\n", "  ", "a", " a", "!", "~", "\u007f", "\u0085", "é", "\U0001F600x", "USD\n", "abc\U0001F600"]
    stamps = ["2024-02-29T01:02:03Z", "2024-02-30T01:02:03Z", "2024-02-29 23:59:59.123456789Z", "2024-02-29T24:00:00Z", "0000-01-01T00:00:00Z",
              "9999-12-31T23:59:59.999999Z", "2024-02-29T01:02:03Z\n", "2024-02-29t01:02:03z", "2024-02-29T01:02:60Z", "2024-02-29T01:02:03.Z", "2024-02-29T01:02Z"]
    df = spark.createDataFrame([(t,) for t in texts + stamps], "t string")
    t = F.col("t")
    blank = F.coalesce(t.rlike(parsing.BLANK), F.lit(True))
    units = (F.octet_length(F.encode(t, "UTF-16BE")) / 2).cast("int")
    other_zone = F.regexp_replace(t, "Z$", "+00:00")                 # the same instant, by the long way
    rows = df.select("t", parsing.is_blank(t), blank, parsing.utf16_length(t), units,
                     parsing.parse_timestamp(t).cast("string"), parsing.parse_timestamp(other_zone).cast("string")).collect()
    assert [r.t for r in rows if r[1] != r[2] or r[3] != r[4] or r[5] != r[6]] == []
    assert [r[5] for r in rows][-11:-8] == ["2024-02-29 01:02:03", None, "2024-02-29 23:59:59.123456"]
