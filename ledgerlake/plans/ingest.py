"""Batch ingest: validate -> dedupe -> customers -> classify -> outputs.

``classify_batch`` builds one lazy plan over a batch of input rows and
returns every row with a ``status`` and its ``errors``; the accepted rows,
the rejects, the new customers and the counters are all projections of
that one frame. ``run_ingest`` materialises it once in the shared
checkpoint folder (so a lost executor recomputes from that table, never
from a store that has meanwhile been appended to), writes customers,
transactions, rejects and counters, and makes all of them visible by one commit.

Precedence per row: invalid (any rule fails) > duplicate (id stored, or a
valid row with the same id came earlier) > accepted. Customers are created
only for accepted rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.parsing import to_stored_amount, utc_now
from ..functions.rules import (AMOUNT_COL, DATE_COL, ERRORS_COL, ERROR_TYPE, as_of_literal,
                               is_valid, validate_text_rows, validate_typed_rows)
from ..operators import customers as cust
from ..operators.dedupe import ORDER_KEY, first_occurrence
from ..operators.skew import split_hot_keys_join


@dataclass
class IngestResult:
    classified: DataFrame
    clock: Column
    as_of: str | None = None

    @property
    def created_customers(self) -> DataFrame:
        """Customers to append (only those of accepted rows, D4)."""
        return cust.created_customers(self.classified, self.clock)

    @property
    def accepted(self) -> DataFrame:
        return accepted_transactions(self.classified, self.as_of)

    @property
    def rejects(self) -> DataFrame:
        return quarantine_rows(self.classified)

    @property
    def counters(self) -> DataFrame:
        return ingest_counters(self.classified)


def _dup_error(code: Column) -> Column:
    return F.struct(F.lit("transactionId").alias("field"), code.alias("code"),
                    F.lit(C.MSG_DUPLICATE).alias("message"))


def _runtime_skew_split(spark) -> bool:
    conf = spark.conf
    return (conf.get("spark.sql.adaptive.enabled", "true").lower() == "true"
            and conf.get("spark.sql.adaptive.skewJoin.enabled", "true").lower() == "true")


def classify_batch(validated: DataFrame, store: DataFrame | None, customers: DataFrame,
                   as_of: str | None = None) -> IngestResult:
    """One status per input row (validated by ``validate_*_rows``).

    Input rows carry ``row_key``, a bigint giving ingest order (file order,
    then row number); the first valid row of an id in that order wins.

    Plan shape: no filter on the rule outcome sits below a shuffle (Catalyst
    would push it through the projection and evaluate every rule twice).
    Instead, only valid rows contribute a key to the owner aggregate (one
    hash aggregate per id, store hits folded in as key -1), every row is
    joined back to its id's owner, and the customer lookup is keyed only for
    accepted rows. A blank or repeated id that fills much of a batch is
    folded map-side by the partial aggregate. In the join back, rows that are
    not valid carry keys of their own, and a valid id that repeats very often is
    split by AQE (both sides are plain shuffles, see below) or, where a cluster
    turns that off, salted by ``split_hot_keys_join``.
    """
    clock = as_of_literal(as_of)
    empty_errors = F.array().cast(ERROR_TYPE)
    valid = is_valid()
    candidates = validated.withColumn("_cand", F.when(valid, F.col(ORDER_KEY)))
    owners = first_occurrence(candidates, store, "_cand")
    # rows that own nothing (invalid ones, null ids) get a key of their own that
    # matches no id, so neither a blank id nor null gathers them in one task
    own = F.concat(F.lit("\u0000"), F.col(ORDER_KEY).cast("string"))
    keyed = validated.withColumn("_id", F.when(valid, F.col("transactionId")).otherwise(own))
    if _runtime_skew_split(validated.sparkSession):
        # the new key makes the owners a shuffle of their own: only a join of two
        # plain shuffles is split by AQE, one onto an aggregate is not
        named = owners.select(F.concat("transactionId", F.lit("")).alias("_id"), "_owner")
        joined = keyed.join(named, "_id", "left").drop("_id")
    else:
        joined = split_hot_keys_join(keyed, owners.withColumnRenamed("transactionId", "_id"), "_id", "_rows",
                                     ORDER_KEY).drop("_id")
    owner = F.col("_owner")
    dup_code = (F.when(owner == -1, F.lit(C.ERR_DUP_STORED))
                .when(owner != F.col(ORDER_KEY), F.lit(C.ERR_DUP_BATCH)))
    staged = (joined
              .withColumn("_valid", valid)
              .withColumn("dup_code", F.when(F.col("_valid"), dup_code))
              .withColumn("_first", F.col("_valid") & F.col("dup_code").isNull())
              .drop("_owner"))
    keyed = cust.resolve_or_assign(staged, customers, key_when=F.col("_first"),
                                   spread_col=ORDER_KEY)
    resolved = F.col("customer_id").isNotNull()
    status = (F.when(~F.col("_valid"), F.lit(C.STATUS_INVALID))
              .when(~F.col("_first"), F.lit(C.STATUS_DUPLICATE))
              .when(resolved, F.lit(C.STATUS_ACCEPTED))
              .otherwise(F.lit(C.STATUS_UNRESOLVED)))
    errors = (F.when(~F.col("_valid"), F.col(ERRORS_COL))
              .when(~F.col("_first"), F.array(_dup_error(F.col("dup_code"))))
              .when(resolved, empty_errors)
              .otherwise(F.array(cust.unresolved_error())))
    classified = (keyed.withColumn("status", status).withColumn(ERRORS_COL, errors)
                  .drop("_valid", "_first", "dup_code"))
    return IngestResult(classified, clock, as_of)


def spread_for_cpu(df: DataFrame, tasks: int | None) -> DataFrame:
    """Give CPU-heavy row work (parsing, rules) ``tasks`` tasks, if the caller says so.

    A batch read from few large row groups (or one multi-line CSV) arrives in
    few partitions; the caller, who knows the input, may spread it round-robin
    before validation. The plan does not depend on the input's size.
    """
    return df.repartition(tasks) if tasks else df


def ingest_text_batch(raw: DataFrame, store: DataFrame | None, customers: DataFrame,
                      as_of: str | None = None, spread_tasks: int | None = None) -> IngestResult:
    """CSV-style batch: all-string rows with ``row_key`` (and usually
    ``source_file`` / ``row_number`` for reporting)."""
    return classify_batch(validate_text_rows(spread_for_cpu(raw, spread_tasks), as_of), store, customers,
                          as_of)


def ingest_typed_batch(records: DataFrame, store: DataFrame | None, customers: DataFrame,
                       as_of: str | None = None, spread_tasks: int | None = None) -> IngestResult:
    """JSON-style batch: ``txn_date`` / ``txn_amount`` already typed."""
    return classify_batch(validate_typed_rows(spread_for_cpu(records, spread_tasks), as_of), store,
                          customers, as_of)


def accepted_transactions(classified: DataFrame, as_of: str | None = None) -> DataFrame:
    """Stored rows built from accepted input rows."""
    return (classified.filter(F.col("status") == C.STATUS_ACCEPTED)
            .select(F.md5(F.col("transactionId")).alias("id"),
                    "customer_id",
                    F.col("transactionId").alias("external_transaction_id"),
                    F.col(DATE_COL).alias("transaction_date"),
                    to_stored_amount(F.col(AMOUNT_COL)).alias("amount"),
                    "currency",
                    F.col("sourceChannel").alias("source_channel"),
                    as_of_literal(as_of).alias("created_at")))


def quarantine_rows(classified: DataFrame) -> DataFrame:
    """Every rejected row with its cause and errors (a table, never collected)."""
    return (classified.filter(F.col("status") != C.STATUS_ACCEPTED)
            .select(*[c for c in ("source_file", "row_number") if c in classified.columns],
                    "transactionId", "status", ERRORS_COL))


def ingest_counters(classified: DataFrame) -> DataFrame:
    """A10: total / accepted / rejected and the reject causes, one row."""
    st = F.col("status")
    return classified.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(st == C.STATUS_ACCEPTED).alias("accepted"),
        F.count_if(st != C.STATUS_ACCEPTED).alias("rejected"),
        F.count_if(st == C.STATUS_DUPLICATE).alias("duplicate"),
        F.count_if(st == C.STATUS_INVALID).alias("invalid"),
        F.count_if(st == C.STATUS_UNRESOLVED).alias("unresolved"),
    )


def outcome_code(status: Column) -> Column:
    """The single-record outcome class: stored 200, conflict 409, unprocessable 422."""
    return (F.when(status == C.STATUS_ACCEPTED, F.lit(200))
            .when(status == C.STATUS_DUPLICATE, F.lit(409)).otherwise(F.lit(422)))


def errors_by_field(classified: DataFrame) -> DataFrame:
    """Rule failures counted per field and code (exploded, then aggregated)."""
    e = classified.select(F.explode(ERRORS_COL).alias("e"))
    return (e.groupBy(F.col("e.field").alias("field"), F.col("e.code").alias("code"))
            .agg(F.count(F.lit(1)).alias("failures")))


#: What a validated row still needs: its place, its id and the values that are stored.
CARRIED = ("source_file", "row_number", ORDER_KEY, "customerId", "transactionId", DATE_COL, AMOUNT_COL,
           "currency", "sourceChannel")


def run_ingest(batch: DataFrame, root: str, label: str, as_of: str | None = None,
               typed: bool = False, base_transactions: DataFrame | None = None,
               base_customers: DataFrame | None = None, spread_tasks: int | None = None) -> dict:
    """Ingest one batch into the store at ``root`` under partition ``label``.

    ``base_*`` are stored tables that live outside ``root`` (e.g. history
    loaded before this engine); they are read, never written. Returns the
    batch counters (one small row).
    """
    from ..operators import id_index
    from ..session import scratch_path
    from ..sources import store
    from ..sources.tables import CUSTOMER_COLUMNS

    spark = batch.sparkSession
    snap = store.snapshot(spark, root)
    cu = snap.read("customers", exclude_batch=label).select(*CUSTOMER_COLUMNS)
    if base_customers is not None:
        cu = base_customers.select(*cu.columns).unionByName(cu)
    if as_of is None:
        # one clock for the whole batch, also when a stage is recomputed
        as_of = spark.range(1).select(utc_now().cast("string")).first()[0]
    # The validated batch is used by several branches of the plan (the id
    # aggregate, the store check, the join back): it is written once to shared
    # storage, so the input is read and the rules are evaluated once. The texts
    # of date and amount end here, their values go on.
    validate = validate_typed_rows if typed else validate_text_rows
    checked = scratch_path(spark, "validated")
    rows = validate(spread_for_cpu(batch, spread_tasks), as_of)
    carried = [c for c in CARRIED if c in rows.columns]
    rows.select(*carried, ERRORS_COL, is_valid().alias("_valid_row")).write.parquet(checked)
    rows = spark.read.parquet(checked)
    # Invalid rows own no id and have no customer: they go to the rejects as they are,
    # and only valid rows, whose errors are empty, are moved by the joins.
    invalid = rows.where(~F.col("_valid_row")).withColumn("status", F.lit(C.STATUS_INVALID))
    valid = rows.where("_valid_row").select(*carried, F.array().cast(ERROR_TYPE).alias(ERRORS_COL))
    # which of the batch's ids are stored: through the id index, not by a scan of the history
    stored = id_index.stored_ids(valid.select("transactionId"), "transactionId", snap, label)
    if base_transactions is not None:
        stored = base_transactions.select("external_transaction_id").unionByName(stored)
    result = classify_batch(valid, stored, cu, as_of)
    # Cut the lineage: the classification is written once to shared
    # storage, and every output below is read from that table.
    staged = scratch_path(spark, "classified")
    result.classified.write.parquet(staged)
    classified = spark.read.parquet(staged)
    done = IngestResult(classified, as_of_literal(as_of), as_of)

    # nothing below is visible before the commit
    run = store.Run(spark, root, label)
    store.write_customers(run, done.created_customers)
    run.transactions(accepted_transactions(classified, as_of))
    outcome = [*carried, "status", ERRORS_COL]
    every = classified.select(*outcome).unionByName(invalid.select(*outcome))
    store.write_rejects(run, quarantine_rows(every))
    # one row: the second use need not count again
    out = ingest_counters(every).first().asDict()
    store.write_counters(run, spark.createDataFrame([tuple(out[c] for c in store.COUNTERS)], store.SCHEMAS["counters"]))
    run.commit()
    for done_with in (checked, staged):
        store.remove(spark, done_with)
    return out
