"""DuckDB SQL for the test-data adapters, used to write oracle queries.

These are the same views as ``ledgerlake.sources.tables`` written as SQL over
the pre-registered test tables; every oracle query starts ``WITH`` them.
"""

from __future__ import annotations

CURRENCY_CASE = ("CASE o_orderkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' "
                 "WHEN 3 THEN 'JPY' ELSE 'CHF' END")
CHANNEL_CASE = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'web' WHEN '2-HIGH' THEN 'mobile' "
                "WHEN '3-MEDIUM' THEN 'pos' WHEN '4-NOT SPECIFIED' THEN 'api' "
                "ELSE 'import' END")

TRANSACTIONS = f"""
SELECT md5(CAST(o_orderkey AS VARCHAR)) AS id,
       CAST(o_custkey AS VARCHAR) AS customer_id,
       'TXN-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS external_transaction_id,
       o_orderdate AS transaction_date,
       CAST(o_totalprice AS DECIMAL(18,4)) AS amount,
       {CURRENCY_CASE} AS currency,
       {CHANNEL_CASE} AS source_channel,
       o_orderdate + INTERVAL 1 DAY AS created_at
FROM orders"""

CUSTOMERS = """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS external_id,
       CAST('1995-01-01 00:00:00' AS TIMESTAMP) AS created_at
FROM customer"""

STORED = "SELECT * FROM transactions WHERE right(external_transaction_id, 1) = '0'"

RAW = f"""
SELECT o_orderkey + 1 AS row_number,
 CASE WHEN k IN (1,26) THEN '' WHEN k=2 THEN repeat('C',101)
      ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR),9,'0') END AS customerId,
 CASE WHEN k=3 THEN '   ' WHEN k=4 THEN repeat('T',256)
      WHEN k=29 THEN 'TXN-' || lpad(CAST(o_orderkey-1 AS VARCHAR),10,'0')
      ELSE 'TXN-' || lpad(CAST(o_orderkey AS VARCHAR),10,'0') END AS transactionId,
 CASE WHEN k=7 THEN '' WHEN k=8 THEN 'not-a-date' WHEN k=9 THEN '2002-01-01T00:00:01Z'
      WHEN k=12 THEN '1991-01-01T00:00:00Z'
      ELSE replace(CAST(o_orderdate AS VARCHAR),' ','T') || 'Z' END AS transactionDate,
 CASE WHEN k=11 THEN '' WHEN k=13 THEN 'abc' WHEN k IN (14,26) THEN '0' WHEN k=15 THEN '-5.00'
      WHEN k=16 THEN '1000000000' WHEN k=17 THEN '1e3' WHEN k=18 THEN '1,234.56785'
      WHEN k=19 THEN '0.00004'
      ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount,
 CASE WHEN k=21 THEN 'usd' WHEN k=22 THEN 'USDD' WHEN k=23 THEN '' WHEN k=24 THEN '12A'
      ELSE {CURRENCY_CASE} END AS currency,
 CASE WHEN k IN (25,26) THEN 'desk' WHEN k=27 THEN '' WHEN k=31 THEN 'WEB'
      ELSE {CHANNEL_CASE} END AS sourceChannel
FROM (SELECT *, o_orderkey % 40 AS k FROM orders) o"""


RAW_EVENTS = """
SELECT event_id + 1 AS row_number,
       'User#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS customerId,
       'EVT-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS transactionId,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS transactionDate,
       CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS amount,
       CASE event_id % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP'
                         WHEN 3 THEN 'JPY' ELSE 'CHF' END AS currency,
       CASE event_type WHEN 'signup' THEN 'web' WHEN 'view' THEN 'mobile' WHEN 'click' THEN 'pos'
                       WHEN 'purchase' THEN 'api' ELSE 'import' END AS sourceChannel
FROM events"""


def with_views(body: str, *extra: tuple[str, str]) -> str:
    """Prefix ``body`` with the adapter views (and any extra named CTEs)."""
    ctes = [("transactions", TRANSACTIONS), ("customers", CUSTOMERS),
            ("stored_transactions", STORED), ("raw_transactions", RAW),
            ("raw_events", RAW_EVENTS), *extra]
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n" + body


# --- validation written in DuckDB SQL ----------------------------------------
# The same grammar as ledgerlake.functions.parsing (ISO branch of the date
# grammar; the other date forms are covered by unit tests).
ISO = (r"^\s*(\d{4}-\d{2}-\d{2})(?:[Tt ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?))?"
       r"\s*([Zz]|[+-]\d{2}(?::?\d{2})?)?\s*$")
DEC = r"^\s*([+-]?)(\d[\d,]*)?(\.(\d*))?([+-]?)\s*$"


def _date_sql(s: str) -> str:
    d, t, o = (f"regexp_extract({s}, '{ISO}', {i})" for i in (1, 2, 3))
    digits = f"regexp_replace({o}, '[^0-9]', '', 'g')"
    off_min = (f"(CASE WHEN upper({o}) IN ('', 'Z') THEN 0 ELSE "
               f"(CASE WHEN left({o},1)='-' THEN -1 ELSE 1 END) * "
               f"(CAST(substr({digits},1,2) AS INTEGER)*60 + "
               f"coalesce(CAST(nullif(substr({digits},3,2),'') AS INTEGER),0)) END)")
    local = f"try_cast({d} || CASE WHEN {t} <> '' THEN ' ' || {t} ELSE '' END AS TIMESTAMP)"
    return (f"CASE WHEN regexp_matches({s}, '{ISO}') "
            f"THEN {local} - to_minutes(CAST({off_min} AS BIGINT)) END")


def _amount_sql(s: str) -> str:
    lead, ip, fr, tr = (f"regexp_extract({s}, '{DEC}', {i})" for i in (1, 2, 4, 5))
    ip = f"replace({ip}, ',', '')"
    text = (f"{lead} || {tr} || coalesce(nullif({ip}, ''), '0') || '.' || "
            f"coalesce(nullif({fr}, ''), '0')")
    return (f"CASE WHEN regexp_matches({s}, '{DEC}') AND length({ip}) + length({fr}) > 0 "
            f"AND NOT ({lead} <> '' AND {tr} <> '') THEN try_cast({text} AS DECIMAL(38,10)) END")


def validated_sql(source: str, as_of: str) -> str:
    """Rows of ``source`` plus txn_date, txn_amount and the list of failing codes."""
    clock = f"TIMESTAMP '{as_of}'"
    blank = "regexp_matches({c}, '^\\s*$')"

    def b(c):
        return blank.format(c=c)
    checks = [
        (b("customerId"), "cust_empty"), ("length(customerId) > 100", "cust_len"),
        (b("transactionId"), "txn_empty"), ("length(transactionId) > 255", "txn_len"),
        (b("transactionDate"), "date_empty"), ("txn_date IS NULL", "date_bad"),
        (f"coalesce(txn_date > {clock}, true)", "date_future"),
        (f"coalesce(txn_date < {clock} - INTERVAL 10 YEAR, true)", "date_old"),
        (b("amount"), "amt_empty"), ("txn_amount IS NULL", "amt_bad"),
        ("coalesce(txn_amount <= 0, true)", "amt_pos"),
        ("coalesce(txn_amount >= 1000000000, true)", "amt_max"),
        (b("currency"), "cur_empty"), ("length(currency) <> 3", "cur_len"),
        ("NOT regexp_matches(currency, '^[A-Z]{3}$')", "cur_fmt"),
        (b("sourceChannel"), "chan_empty"),
        ("NOT coalesce(sourceChannel IN ('web','mobile','pos','api','import'), false)",
         "chan_set"),
    ]
    items = ", ".join(f"CASE WHEN {c} THEN '{code}' END" for c, code in checks)
    return f"""
SELECT *, list_filter([{items}], lambda x: x IS NOT NULL) AS codes
FROM (SELECT *, {_date_sql('transactionDate')} AS txn_date,
             {_amount_sql('amount')} AS txn_amount
      FROM {source}) p"""


def classified_sql(validated: str, order: str = "row_number") -> str:
    """Status per row: invalid > duplicate (stored, or not the first valid row in
    ``order``) > accepted."""
    return f"""
SELECT v.*,
  CASE WHEN len(codes) > 0 THEN 'invalid'
       WHEN transactionId IN (SELECT external_transaction_id FROM stored_transactions)
            THEN 'duplicate'
       WHEN {order} <> min(CASE WHEN len(codes) = 0 THEN {order} END)
                          OVER (PARTITION BY transactionId) THEN 'duplicate'
       ELSE 'accepted' END AS status,
  CASE WHEN len(codes) > 0 THEN NULL
       WHEN transactionId IN (SELECT external_transaction_id FROM stored_transactions)
            THEN 'dup_stored'
       WHEN {order} <> min(CASE WHEN len(codes) = 0 THEN {order} END)
                          OVER (PARTITION BY transactionId) THEN 'dup_batch' END AS dup_code
FROM {validated} v"""


def validated_json_sql(source: str, as_of: str) -> str:
    """Typed-record (JSON) rule set over ``source``: amount is a JSON number
    (text cast as a number), the date must be ISO text, else the record is corrupt."""
    clock = f"TIMESTAMP '{as_of}'"

    def b(c):
        return f"regexp_matches({c}, '^\\s*$')"
    checks = [
        ("transactionDate IS NOT NULL AND txn_date IS NULL", "record_corrupt"),
        (b("customerId"), "cust_empty"), ("length(customerId) > 100", "cust_len"),
        (b("transactionId"), "txn_empty"), ("length(transactionId) > 255", "txn_len"),
        ("txn_date IS NULL", "date_empty"), (f"txn_date > {clock}", "date_future"),
        (f"coalesce(txn_date < {clock} - INTERVAL 10 YEAR, true)", "date_old"),
        ("coalesce(txn_amount, 0) <= 0", "amt_pos"),
        ("coalesce(txn_amount, 0) >= 1000000000", "amt_max"),
        (b("currency"), "cur_empty"), ("length(currency) <> 3", "cur_len"),
        ("NOT regexp_matches(currency, '^[A-Z]{3}$')", "cur_fmt"),
        (b("sourceChannel"), "chan_empty"),
        ("NOT coalesce(sourceChannel IN ('web','mobile','pos','api','import'), false)",
         "chan_set"),
    ]
    items = ", ".join(f"CASE WHEN {c} THEN '{code}' END" for c, code in checks)
    return f"""
SELECT *, list_filter([{items}], lambda x: x IS NOT NULL) AS codes
FROM (SELECT * EXCLUDE (amount), {_date_sql('transactionDate')} AS txn_date,
             try_cast(amount AS DECIMAL(38,10)) AS txn_amount
      FROM {source}) p"""
