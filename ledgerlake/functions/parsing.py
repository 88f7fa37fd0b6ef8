"""Column expressions that turn input text into typed values.

All of them are built-in Catalyst expressions, so they run inside
whole-stage codegen; none needs a Python UDF. Parsing never raises: text
outside the grammar yields null, which the validation rules report.

Timestamps are returned as ``timestamp_ntz`` holding UTC wall-clock time:
an explicit offset is applied by arithmetic and text without an offset is
taken as UTC, so the result does not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

# ISO 8601 date, optionally with a time (T or blank), seconds, fraction, and Z/offset.
ISO_DATETIME = (r"^\s*(\d{4}-\d{2}-\d{2})"
                r"(?:[Tt ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?))?"
                r"\s*([Zz]|[+-]\d{2}(?::?\d{2})?)?\s*$")
# The plainest of these: a whole time in UTC. Without its Z it is cast as it stands.
UTC_DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?Z\z"
# Month/day/year, year/month/day (slashes or dashes) and day month-name year,
# each optionally with hours:minutes[:seconds] and AM or PM.
_CLOCK = r"(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s*([AaPp])[Mm])?)?\s*$"
US_DATETIME = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})" + _CLOCK
YMD_DATETIME = r"^\s*(\d{4})[/-](\d{1,2})[/-](\d{1,2})" + _CLOCK
NAMED_DATETIME = r"^\s*(\d{1,2})[ -]([A-Za-z]{3,9})[ -](\d{4})" + _CLOCK
# RFC 1123, e.g. "Mon, 15 Jan 2024 10:00:00 GMT".
RFC1123_DATETIME = (r"^\s*(?:[A-Za-z]{3},\s*)?(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\s+"
                    r"(\d{2}):(\d{2}):(\d{2})\s*(?:GMT|UTC|Z)\s*$")
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september",
               "october", "november", "december")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Invariant-culture decimal: blanks around, one optional sign (leading or
# trailing), digits with thousands commas before an optional point, at least
# one digit, no exponent, no currency symbol.
_NUM = r"(?:\d[\d,]*(?:\.\d*)?|\.\d+)"
DECIMAL_GATE = rf"^\s*(?:[+-]?{_NUM}|{_NUM}[+-])\s*$"

BLANK = r"(?U)^\s*$"


def is_blank(c: Column) -> Column:
    """Null, empty or only (Unicode) white space.

    Text whose first byte is a visible ASCII sign, most text, is told without the pattern.
    """
    return F.when((c >= "!") & (c < "\u007f"), F.lit(False)).otherwise(F.coalesce(c.rlike(BLANK), F.lit(True)))


def utf16_length(c: Column) -> Column:
    """String length in UTF-16 code units, as the original's limits count
    it (a character outside the Basic Multilingual Plane counts twice). Text
    of one byte a character needs no encoding."""
    return (F.when(F.octet_length(c) == F.length(c), F.length(c))
            .otherwise((F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")))


def utc_wall_clock(instant: Column) -> Column:
    """An instant as UTC wall-clock time, by arithmetic on its microseconds: a session
    zone with repeated hours (the end of daylight saving time) plays no part."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def _iso_timestamp(s: Column) -> Column:
    """ISO branch: one regex gate, then Spark's own timestamp casts.

    The gate keeps out what the casts would over-accept ('2024', '12:30').
    Text without an offset is UTC wall-clock already and is cast straight to
    ``timestamp_ntz``; text with Z or an offset is cast to an instant, which is
    turned into UTC wall-clock. Neither depends on the session time zone. A whole
    time with Z, the common form, is known by one short pattern and cast without its Z.
    """
    text = F.upper(s)
    has_offset = F.regexp_extract(s, ISO_DATETIME, 3) != ""
    # the cast wants seconds before an offset
    instant = F.regexp_replace(text, r"([T ]\d{2}:\d{2})(\s*(?:Z|[+-]\d|$))", "$1:00$2").try_cast("timestamp")
    return (F.when(s.rlike(UTC_DATETIME), F.left(s, F.length(s) - 1).try_cast("timestamp_ntz"))
            .when(s.rlike(ISO_DATETIME),
                  F.when(has_offset, utc_wall_clock(instant)).otherwise(text.try_cast("timestamp_ntz"))))


def _clock_timestamp(s: Column, pattern: str, year: int, month: int, day: int) -> Column:
    """A date in the given groups with an optional clock in groups 4 to 7."""
    g = {i: F.nullif(F.regexp_extract(s, pattern, i), F.lit("")) for i in range(1, 8)}
    names = F.array(*[F.lit(m) for m in MONTHS])
    full = F.array(*[F.lit(m) for m in MONTH_NAMES])
    named = F.lower(g[month])
    # a short name, or the whole one
    by_name = F.greatest(F.array_position(names, named), F.array_position(full, named)).cast("int")
    month_no = F.when(g[month].rlike("^[0-9]+$"), g[month].try_cast("int")).otherwise(F.nullif(by_name, F.lit(0)))
    hour, half = F.coalesce(g[4].try_cast("int"), F.lit(0)), F.lower(g[7])
    hour = (F.when(half.isNull(), hour).when((hour < 1) | (hour > 12), F.lit(None))
            .when(half == "p", hour % 12 + 12).otherwise(hour % 12))
    return F.when(s.rlike(pattern) & month_no.isNotNull() & hour.isNotNull(), F.try_make_timestamp_ntz(
        g[year].try_cast("int"), month_no, g[day].try_cast("int"), hour, F.coalesce(g[5].try_cast("int"), F.lit(0)),
        F.coalesce(g[6].try_cast("int"), F.lit(0)).cast("decimal(16,6)")))


def _rfc1123_timestamp(s: Column) -> Column:
    g = [F.regexp_extract(s, RFC1123_DATETIME, i) for i in range(1, 7)]
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(g[1])).cast("int")
    return F.when(s.rlike(RFC1123_DATETIME) & (month > 0), F.try_make_timestamp_ntz(
        g[2].cast("int"), month, g[0].cast("int"), g[3].cast("int"), g[4].cast("int"),
        g[5].cast("decimal(16,6)")))


def utc_now() -> Column:
    """The current instant as UTC wall-clock ``timestamp_ntz`` (any session zone)."""
    return utc_wall_clock(F.current_timestamp())


def parse_timestamp(s: Column) -> Column:
    """Text -> timestamp_ntz (UTC), or null when outside the grammar.

    The forms besides ISO stand in a lambda: it is evaluated only where the ISO
    form gives null, and its code is not generated into the projection, which
    would grow beyond what the compiler takes (64 KB a method).
    """
    other = F.transform(F.array(s), lambda t: F.coalesce(
        _clock_timestamp(t, US_DATETIME, 3, 1, 2), _clock_timestamp(t, YMD_DATETIME, 1, 2, 3),
        _clock_timestamp(t, NAMED_DATETIME, 3, 2, 1), _rfc1123_timestamp(t)))
    return F.coalesce(_iso_timestamp(s), other[0])


def parse_amount(s: Column) -> Column:
    """Invariant decimal text -> decimal(38,10), or null.

    One regex gate accepts the grammar (it rejects what a bare cast would
    wrongly accept, like ``1e3``); then commas and surrounding blanks are
    dropped (a bare cast would wrongly reject ``1,234.5``) and a trailing
    sign is moved to the front before the cast.
    """
    bare = F.regexp_replace(s, r"[\s,]", "")
    last = F.substring(bare, -1, 1)
    trailing = last.isin("+", "-")
    signed = F.when(trailing, F.concat(last, F.substring(bare, F.lit(1), F.length(bare) - 1)))
    return F.when(s.rlike(DECIMAL_GATE),
                  F.coalesce(signed, bare).try_cast(C.PARSE_DECIMAL))


def to_stored_amount(a: Column) -> Column:
    """Round half away from zero to the stored scale."""
    return a.cast(C.STORED_DECIMAL)


def surrogate_id(external_id: Column) -> Column:
    """Deterministic 128-bit hex id, stable across replays and re-runs."""
    return F.md5(external_id)


def page_count(total: Column, page_size: Column) -> Column:
    """Ceiling division; a page size of 0 gives 0 pages."""
    return F.when(page_size > 0, F.floor((total + page_size - 1) / page_size).cast("bigint")) \
        .otherwise(F.lit(0).cast("bigint"))
