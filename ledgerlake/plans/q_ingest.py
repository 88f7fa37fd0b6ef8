"""Registered ingest queries over the dirty fixture input."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import parsing
from ..functions.rules import error_codes, is_valid, validate_text_rows
from ..operators import customers as cust
from ..operators import dedupe
from ..sources import tables
from . import ingest
from .oracle import classified_sql, validated_sql
from .registry import register

from .params import AS_OF, EVENTS_AS_OF

V = (("validated", validated_sql("raw_transactions", AS_OF)),)
CL = V + (("classified", classified_sql("validated")),)
EV = (("validated_events", validated_sql("raw_events", EVENTS_AS_OF)),)


def raw_batch(spark, sf):
    # one logical input file: ingest order is the row number
    return tables.raw_transactions(spark, sf).withColumns(
        {"source_file": F.lit("orders"), "row_key": F.col("row_number")})


def events_batch(spark, sf):
    return tables.raw_events(spark, sf).withColumns(
        {"source_file": F.lit("events"), "row_key": F.col("row_number")})


def spread_tasks(spark):
    """Tasks to spread a batch over before validation, if the session sets them (its input may be one row group)."""
    tasks = spark.conf.get("spark.ledgerlake.spreadTasks", None)
    return int(tasks) if tasks else None


def validated(spark, sf):
    return validate_text_rows(ingest.spread_for_cpu(raw_batch(spark, sf), spread_tasks(spark)), AS_OF)


def classified(spark, sf):
    return ingest.ingest_text_batch(raw_batch(spark, sf), tables.stored_transactions(spark, sf),
                                    tables.customers(spark, sf), AS_OF, spread_tasks(spark))


@register("validate_rows", """
SELECT row_number, transactionId, array_to_string(codes, ',') AS error_codes,
       CAST(len(codes) AS BIGINT) AS n_errors
FROM validated""", V)
def q_validate_rows(spark, sf):
    return validated(spark, sf).select("row_number", "transactionId",
                                       error_codes().alias("error_codes"),
                                       F.size("errors").cast("bigint").alias("n_errors"))


@register("valid_rows", "SELECT row_number, transactionId FROM validated WHERE len(codes) = 0", V)
def q_valid_rows(spark, sf):
    return validated(spark, sf).filter(is_valid()).select("row_number", "transactionId")


@register("invalid_rows", """
SELECT row_number, transactionId, array_to_string(codes, ',') AS error_codes
FROM validated WHERE len(codes) > 0""", V)
def q_invalid_rows(spark, sf):
    return (validated(spark, sf).filter(~is_valid())
            .select("row_number", "transactionId", error_codes().alias("error_codes")))


@register("parse_timestamps", "SELECT row_number, transactionDate, txn_date FROM validated", V)
def q_parse_timestamps(spark, sf):
    return validated(spark, sf).select("row_number", "transactionDate", "txn_date")


@register("parse_amounts", "SELECT row_number, amount, txn_amount FROM validated", V)
def q_parse_amounts(spark, sf):
    return validated(spark, sf).select("row_number", "amount", "txn_amount")


@register("round_amount_scale4", """
SELECT row_number, CAST(txn_amount AS DECIMAL(18,4)) AS stored_amount
FROM validated WHERE txn_amount IS NOT NULL""", V)
def q_round_amount_scale4(spark, sf):
    return (validated(spark, sf).filter(F.col("txn_amount").isNotNull())
            .select("row_number",
                    parsing.to_stored_amount(F.col("txn_amount")).alias("stored_amount")))


@register("blank_test", """
SELECT row_number,
       regexp_matches(customerId, '^\\s*$') AS customer_blank,
       regexp_matches(transactionId, '^\\s*$') AS transaction_blank,
       regexp_matches(currency, '^\\s*$') AS currency_blank
FROM raw_transactions""")
def q_blank_test(spark, sf):
    r = tables.raw_transactions(spark, sf)
    return r.select("row_number", parsing.is_blank(F.col("customerId")).alias("customer_blank"),
                    parsing.is_blank(F.col("transactionId")).alias("transaction_blank"),
                    parsing.is_blank(F.col("currency")).alias("currency_blank"))


@register("validate_json_rows", """
SELECT row_number, transactionId,
       array_to_string(list_filter([
         CASE WHEN regexp_matches(customerId, '^\\s*$') THEN 'cust_empty' END,
         CASE WHEN length(customerId) > 100 THEN 'cust_len' END,
         CASE WHEN regexp_matches(transactionId, '^\\s*$') THEN 'txn_empty' END,
         CASE WHEN length(transactionId) > 255 THEN 'txn_len' END,
         CASE WHEN txn_date IS NULL THEN 'date_empty' END,
         CASE WHEN txn_date > TIMESTAMP '2002-01-01 00:00:00' THEN 'date_future' END,
         CASE WHEN coalesce(txn_date < TIMESTAMP '2002-01-01 00:00:00' - INTERVAL 10 YEAR, true)
              THEN 'date_old' END,
         CASE WHEN coalesce(txn_amount, 0) <= 0 THEN 'amt_pos' END,
         CASE WHEN coalesce(txn_amount, 0) >= 1000000000 THEN 'amt_max' END,
         CASE WHEN regexp_matches(currency, '^\\s*$') THEN 'cur_empty' END,
         CASE WHEN length(currency) <> 3 THEN 'cur_len' END,
         CASE WHEN NOT regexp_matches(currency, '^[A-Z]{3}$') THEN 'cur_fmt' END,
         CASE WHEN regexp_matches(sourceChannel, '^\\s*$') THEN 'chan_empty' END,
         CASE WHEN NOT coalesce(sourceChannel IN ('web','mobile','pos','api','import'), false)
              THEN 'chan_set' END], lambda x: x IS NOT NULL), ',') AS error_codes
FROM validated""", V)
def q_validate_json_rows(spark, sf):
    # typed records: the date and amount as a JSON reader would type them
    from ..functions.rules import validate_typed_rows
    v = validated(spark, sf).select("row_number", "customerId", "transactionId", "currency",
                                    "sourceChannel", "txn_date", "txn_amount")
    return validate_typed_rows(v, AS_OF).select("row_number", "transactionId",
                                                error_codes().alias("error_codes"))


@register("classify_rows", "SELECT row_number, transactionId, status FROM classified", CL)
def q_classify_rows(spark, sf):
    return classified(spark, sf).classified.select("row_number", "transactionId", "status")


@register("quarantine_rows", """
SELECT row_number, transactionId, status,
       CASE WHEN status = 'invalid' THEN array_to_string(codes, ',') ELSE dup_code END
         AS error_codes
FROM classified WHERE status <> 'accepted'""", CL)
def q_quarantine_rows(spark, sf):
    return (ingest.quarantine_rows(classified(spark, sf).classified)
            .select("row_number", "transactionId", "status", error_codes().alias("error_codes")))


@register("ingest_counters", """
SELECT count(*) AS total_rows, count(*) FILTER (WHERE status = 'accepted') AS accepted,
       count(*) FILTER (WHERE status <> 'accepted') AS rejected,
       count(*) FILTER (WHERE status = 'duplicate') AS duplicate,
       count(*) FILTER (WHERE status = 'invalid') AS invalid,
       CAST(0 AS BIGINT) AS unresolved
FROM classified""", CL)
def q_ingest_counters(spark, sf):
    return classified(spark, sf).counters


@register("errors_by_field", """
SELECT CASE split_part(code, '_', 1) WHEN 'cust' THEN 'customerId' WHEN 'txn' THEN 'transactionId'
         WHEN 'date' THEN 'transactionDate' WHEN 'amt' THEN 'amount' WHEN 'cur' THEN 'currency'
         WHEN 'chan' THEN 'sourceChannel' ELSE 'transactionId' END AS field,
       code, count(*) AS failures
FROM (SELECT unnest(CASE WHEN status = 'invalid' THEN codes ELSE [dup_code] END) AS code
      FROM classified WHERE status <> 'accepted')
GROUP BY 1, 2""", CL)
def q_errors_by_field(spark, sf):
    return ingest.errors_by_field(classified(spark, sf).classified)


@register("ingest_accepted", f"""
SELECT md5(transactionId) AS id, c.id AS customer_id, transactionId AS external_transaction_id,
       txn_date AS transaction_date, CAST(txn_amount AS DECIMAL(18,4)) AS amount, currency,
       sourceChannel AS source_channel, TIMESTAMP '{AS_OF}' AS created_at
FROM classified k JOIN customers c ON c.external_id = k.customerId
WHERE status = 'accepted'""", CL)
def q_ingest_accepted(spark, sf):
    return ingest.accepted_transactions(classified(spark, sf).classified, AS_OF)


@register("existing_ids", """
SELECT DISTINCT transactionId FROM raw_transactions
WHERE transactionId IN (SELECT external_transaction_id FROM stored_transactions)""")
def q_existing_ids(spark, sf):
    return dedupe.existing_ids(tables.raw_transactions(spark, sf),
                               tables.stored_transactions(spark, sf))


@register("new_rows", """
SELECT row_number, transactionId FROM validated
WHERE len(codes) = 0
  AND transactionId NOT IN (SELECT external_transaction_id FROM stored_transactions)""", V)
def q_new_rows(spark, sf):
    v = validated(spark, sf).filter(is_valid()).select("row_number", "transactionId")
    return dedupe.new_rows(v, tables.stored_transactions(spark, sf))


@register("exists_flags", """
SELECT row_number, transactionId,
       transactionId IN (SELECT external_transaction_id FROM stored_transactions) AS "exists"
FROM raw_transactions""")
def q_exists_flags(spark, sf):
    r = tables.raw_transactions(spark, sf).select("row_number", "transactionId")
    return dedupe.exists_flags(r, tables.stored_transactions(spark, sf)) \
        .select("row_number", "transactionId", "exists")


@register("dedupe_within_batch", """
SELECT row_number, transactionId,
       row_number = min(row_number) OVER (PARTITION BY transactionId) AS is_first
FROM validated WHERE len(codes) = 0""", V)
def q_dedupe_within_batch(spark, sf):
    v = validated(spark, sf).filter(is_valid())
    marked = dedupe.mark_duplicates(v, None)
    return marked.select("row_number", "transactionId",
                         F.col("dup_code").isNull().alias("is_first"))


@register("distinct_customers", """
SELECT DISTINCT customerId AS external_id FROM classified WHERE status = 'accepted'""", CL)
def q_distinct_customers(spark, sf):
    acc = classified(spark, sf).classified.filter(F.col("status") == C.STATUS_ACCEPTED)
    return cust.distinct_customers(acc)


@register("missing_customers", """
SELECT DISTINCT customerId AS external_id FROM validated_events
WHERE len(codes) = 0 AND customerId NOT IN (SELECT external_id FROM customers)""", EV)
def q_missing_customers(spark, sf):
    v = validate_text_rows(events_batch(spark, sf), EVENTS_AS_OF).filter(is_valid())
    return cust.missing_customers(cust.distinct_customers(v), tables.customers(spark, sf))


WANTED = (("wanted", """
  SELECT customerId AS external_id FROM classified WHERE status = 'accepted'
  UNION SELECT customerId FROM validated_events WHERE len(codes) = 0"""),)


@register("get_or_create_customers", f"""
SELECT c.id, c.external_id, c.created_at FROM customers c
WHERE c.external_id IN (SELECT external_id FROM wanted)
UNION ALL
SELECT md5(external_id), external_id, TIMESTAMP '{EVENTS_AS_OF}' FROM wanted
WHERE external_id NOT IN (SELECT external_id FROM customers)""", CL + EV + WANTED)
def q_get_or_create_customers(spark, sf):
    acc = classified(spark, sf).classified.filter(F.col("status") == C.STATUS_ACCEPTED)
    ev = validate_text_rows(events_batch(spark, sf), EVENTS_AS_OF).filter(is_valid())
    wanted = cust.distinct_customers(acc).unionByName(cust.distinct_customers(ev)).distinct()
    resolved, _ = cust.get_or_create(wanted, tables.customers(spark, sf),
                                     F.lit(EVENTS_AS_OF).cast("timestamp_ntz"))
    return resolved


@register("ingest_new_customers", f"""
SELECT DISTINCT md5(customerId) AS id, customerId AS external_id,
       TIMESTAMP '{EVENTS_AS_OF}' AS created_at
FROM validated_events WHERE len(codes) = 0""", EV)
def q_ingest_new_customers(spark, sf):
    res = ingest.ingest_text_batch(events_batch(spark, sf), tables.transactions(spark, sf),
                                   tables.customers(spark, sf), EVENTS_AS_OF)
    return res.created_customers


@register("resolve_customer_keys", """
SELECT k.row_number, k.transactionId, c.id AS customer_id
FROM classified k LEFT JOIN customers c ON c.external_id = k.customerId
WHERE status = 'accepted'""", CL)
def q_resolve_customer_keys(spark, sf):
    acc = classified(spark, sf).classified.filter(F.col("status") == C.STATUS_ACCEPTED)
    return acc.select("row_number", "transactionId", "customer_id")


@register("surrogate_keys", """
SELECT transactionId AS external_transaction_id, md5(transactionId) AS id
FROM classified WHERE status = 'accepted'""", CL)
def q_surrogate_keys(spark, sf):
    acc = ingest.accepted_transactions(classified(spark, sf).classified, AS_OF)
    return acc.select("external_transaction_id", "id")


@register("append_single", """
SELECT row_number, transactionId, status,
       CASE status WHEN 'accepted' THEN 200 WHEN 'duplicate' THEN 409 ELSE 422 END AS outcome
FROM classified""", CL)
def q_append_single(spark, sf):
    # S7 set-wise: every record gets the single-append outcome of the original
    # (stored / conflict / unprocessable) from one classification pass
    c = classified(spark, sf).classified
    return c.select("row_number", "transactionId", "status",
                    ingest.outcome_code(F.col("status")).alias("outcome"))


@register("bulk_append_idempotent", """
SELECT md5(transactionId) AS id, c.id AS customer_id, transactionId AS external_transaction_id,
       txn_date AS transaction_date, CAST(txn_amount AS DECIMAL(18,4)) AS amount, currency,
       sourceChannel AS source_channel, TIMESTAMP '2002-01-01 00:00:00' AS created_at
FROM classified k JOIN customers c ON c.external_id = k.customerId
WHERE status = 'accepted'""", CL)
def q_bulk_append_idempotent(spark, sf):
    # The batch is appended, replayed under the same label, then offered
    # again under a new label; the store must hold each accepted row once
    from ..session import scratch_path
    from ..sources import store
    root = scratch_path(spark, "bulk-store")
    kw = dict(as_of=AS_OF, base_transactions=tables.stored_transactions(spark, sf),
              base_customers=tables.customers(spark, sf))
    raw = raw_batch(spark, sf)
    ingest.run_ingest(raw, root, "b1", **kw)
    ingest.run_ingest(raw, root, "b1", **kw)
    ingest.run_ingest(raw, root, "b2", **kw)
    return store.read_transactions(spark, root, with_partitions=False)
