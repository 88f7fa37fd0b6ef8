"""Row validation as one column expression per rule.

A rule is a boolean column that is true when the row breaks it. All rules of
a rule set are evaluated (no short-circuit), and the failing ones become an
``errors`` array of (field, code, message) structs in rule order. The whole
thing is a projection: no shuffle, no Python, and it fuses into the scan's
codegen stage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .parsing import is_blank, parse_amount, parse_timestamp, utc_now, utf16_length

# Parsed helper columns added next to the input fields.
DATE_COL = "txn_date"
AMOUNT_COL = "txn_amount"
ERRORS_COL = "errors"

ERROR_STRUCT = "struct<field:string,code:string,message:string>"
ERROR_TYPE = f"array<{ERROR_STRUCT}>"


@dataclass(frozen=True)
class Rule:
    field: str
    code: str
    message: str
    fails: Callable[[Callable[[str], Column], Column], Column]  # (col, as_of) -> Column


def _no(c: Column) -> Column:
    """A comparison on null input counts as a failure."""
    return F.coalesce(c, F.lit(True))


def _len_over(name: str, n: int) -> Callable:
    return lambda col, as_of: F.coalesce(utf16_length(col(name)) > n, F.lit(False))


def _oldest(as_of: Column) -> Column:
    return as_of - F.make_ym_interval(F.lit(C.MAX_AGE_YEARS), F.lit(0))


_CUSTOMER = [
    Rule("customerId", C.ERR_CUST_EMPTY, "Customer id must not be empty.",
         lambda col, as_of: is_blank(col("customerId"))),
    Rule("customerId", C.ERR_CUST_LEN,
         f"Customer id must be {C.CUSTOMER_ID_MAX_LEN} characters or fewer.",
         _len_over("customerId", C.CUSTOMER_ID_MAX_LEN)),
    Rule("transactionId", C.ERR_TXN_EMPTY, "Transaction id must not be empty.",
         lambda col, as_of: is_blank(col("transactionId"))),
    Rule("transactionId", C.ERR_TXN_LEN,
         f"Transaction id must be {C.TRANSACTION_ID_MAX_LEN} characters or fewer.",
         _len_over("transactionId", C.TRANSACTION_ID_MAX_LEN)),
]

_CURRENCY_CHANNEL = [
    Rule("currency", C.ERR_CUR_EMPTY, "Currency must not be empty.",
         lambda col, as_of: is_blank(col("currency"))),
    Rule("currency", C.ERR_CUR_LEN, f"Currency must be exactly {C.CURRENCY_LEN} characters.",
         lambda col, as_of: F.coalesce(utf16_length(col("currency")) != C.CURRENCY_LEN,
                                       F.lit(False))),
    Rule("currency", C.ERR_CUR_FMT, "Currency must be three upper-case letters.",
         lambda col, as_of: F.coalesce(~col("currency").rlike(C.CURRENCY_PATTERN),
                                       F.lit(False))),
    Rule("sourceChannel", C.ERR_CHAN_EMPTY, "Source channel must not be empty.",
         lambda col, as_of: is_blank(col("sourceChannel"))),
    Rule("sourceChannel", C.ERR_CHAN_SET, C.MSG_CHANNEL_SET,
         lambda col, as_of: ~F.coalesce(col("sourceChannel").isin(*C.ALLOWED_CHANNELS),
                                        F.lit(False))),
]

# Rules for text input (CSV rows): every field is a string, missing = "".
CSV_RULES: tuple[Rule, ...] = tuple(_CUSTOMER + [
    Rule("transactionDate", C.ERR_DATE_EMPTY, "Transaction date must not be empty.",
         lambda col, as_of: is_blank(col("transactionDate"))),
    Rule("transactionDate", C.ERR_DATE_BAD, C.MSG_DATE_INVALID,
         lambda col, as_of: col(DATE_COL).isNull()),
    Rule("transactionDate", C.ERR_DATE_FUTURE, C.MSG_DATE_FUTURE,
         lambda col, as_of: _no(col(DATE_COL) > as_of)),
    Rule("transactionDate", C.ERR_DATE_OLD, C.MSG_DATE_TOO_OLD,
         lambda col, as_of: _no(col(DATE_COL) < _oldest(as_of))),
    Rule("amount", C.ERR_AMT_EMPTY, "Amount must not be empty.",
         lambda col, as_of: is_blank(col("amount"))),
    Rule("amount", C.ERR_AMT_BAD, C.MSG_AMOUNT_INVALID,
         lambda col, as_of: col(AMOUNT_COL).isNull()),
    Rule("amount", C.ERR_AMT_POS, C.MSG_AMOUNT_POSITIVE,
         lambda col, as_of: _no(col(AMOUNT_COL) <= 0)),
    Rule("amount", C.ERR_AMT_MAX, C.MSG_AMOUNT_MAX,
         lambda col, as_of: _no(col(AMOUNT_COL) >= C.AMOUNT_UPPER_EXCLUSIVE)),
] + _CURRENCY_CHANNEL)

# Rules for typed records (JSON): date and amount arrive typed. A missing date
# is the type's default (far past): required and too old, but not future. A
# missing amount counts as 0.
JSON_RULES: tuple[Rule, ...] = tuple(_CUSTOMER + [
    Rule("transactionDate", C.ERR_DATE_EMPTY, C.MSG_DATE_REQUIRED,
         lambda col, as_of: col(DATE_COL).isNull()),
    Rule("transactionDate", C.ERR_DATE_FUTURE, C.MSG_DATE_FUTURE,
         lambda col, as_of: F.coalesce(col(DATE_COL) > as_of, F.lit(False))),
    Rule("transactionDate", C.ERR_DATE_OLD, C.MSG_DATE_TOO_OLD,
         lambda col, as_of: _no(col(DATE_COL) < _oldest(as_of))),
    Rule("amount", C.ERR_AMT_POS, "Amount must be greater than '0'.",
         lambda col, as_of: F.coalesce(col(AMOUNT_COL), F.lit(0)) <= 0),
    Rule("amount", C.ERR_AMT_MAX, "Amount must be less than '1000000000'.",
         lambda col, as_of: F.coalesce(col(AMOUNT_COL), F.lit(0)) >= C.AMOUNT_UPPER_EXCLUSIVE),
] + _CURRENCY_CHANNEL)


def as_of_literal(as_of: str | None) -> Column:
    """The validation clock, fixed for the whole query (one value per run)."""
    if as_of is None:
        return utc_now()
    return F.lit(as_of).cast("timestamp_ntz")


def errors_expr(rules: tuple[Rule, ...], as_of: Column) -> Column:
    """Array of failing rules, in rule order."""
    # an empty or one-entry list for each rule, joined: all of it is generated code, and
    # each rule is evaluated once (array_compact is a lambda, array_except of structs
    # compares them one by one)
    none = F.array().cast(ERROR_TYPE)
    return F.concat(*[
        F.when(r.fails(F.col, as_of),
               F.array(F.struct(F.lit(r.field).alias("field"), F.lit(r.code).alias("code"),
                                F.lit(r.message).alias("message")))).otherwise(none)
        for r in rules])


def validate_text_rows(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """V18 over all-string input: parse date and amount, then evaluate CSV_RULES.

    Null fields are read as "" (a missing CSV cell and an empty one are the same).
    """
    clock = as_of_literal(as_of)
    filled = df.withColumns({f: F.coalesce(F.col(f), F.lit("")) for f in C.INPUT_FIELDS})
    parsed = filled.withColumns({DATE_COL: parse_timestamp(F.col("transactionDate")),
                                 AMOUNT_COL: parse_amount(F.col("amount"))})
    return parsed.withColumn(ERRORS_COL, errors_expr(CSV_RULES, clock))


def validate_typed_rows(df: DataFrame, as_of: str | None = None,
                        corrupt_col: str | None = "_corrupt_record") -> DataFrame:
    """V19 over typed records (date already a timestamp, amount a decimal).

    Expects ``txn_date`` and ``txn_amount`` columns; a non-null corrupt-record
    column adds a ``record_corrupt`` error in front of the rule errors.
    """
    clock = as_of_literal(as_of)
    errs = errors_expr(JSON_RULES, clock)
    if corrupt_col and corrupt_col in df.columns:
        corrupt = F.array_compact(F.array(F.when(
            F.col(corrupt_col).isNotNull(),
            F.struct(F.lit("record").alias("field"), F.lit(C.ERR_RECORD_CORRUPT).alias("code"),
                     F.lit("Record is not a valid transaction document.").alias("message")))))
        errs = F.concat(corrupt, errs)
    return df.withColumn(ERRORS_COL, errs)


def error_codes(col: str = ERRORS_COL) -> Column:
    """Comma-joined codes of an errors array (for reports and comparisons)."""
    return F.array_join(F.transform(F.col(col), lambda e: e["code"]), ",")


def is_valid(col: str = ERRORS_COL) -> Column:
    return F.size(F.col(col)) == 0
