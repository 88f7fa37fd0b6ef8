"""Integrity audits over the stored tables.

The store is plain Parquet, so the constraints of the original tables are
kept by construction (single writer, anti-joins before append) and checked
by these jobs. Each returns the violating rows (or one row of counts), and
each is a single aggregate or anti-join: partial aggregation map-side, then
one shuffle on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences"))
            .filter(F.col("occurrences") > 1))


def orphans(tx: DataFrame, customers: DataFrame) -> DataFrame:
    """Transactions whose customer_id has no customer row."""
    return tx.join(customers.select(F.col("id").alias("customer_id")), "customer_id", "left_anti")


def null_counts(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """C4: one row, the number of nulls per not-null column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def width_violations(tx: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """One row, counts of values beyond the declared widths and precision."""
    amount_limit = 10 ** (C.AMOUNT_PRECISION - C.AMOUNT_SCALE)
    checks = [
        F.count_if(F.length("external_transaction_id") > C.TRANSACTION_ID_MAX_LEN)
        .alias("txn_id_too_long"),
        F.count_if(F.length("currency") != C.CURRENCY_LEN).alias("currency_bad_length"),
        F.count_if(F.length("source_channel") > C.CHANNEL_MAX_LEN).alias("channel_too_long"),
        F.count_if(F.abs(F.col("amount")) >= amount_limit).alias("amount_out_of_precision"),
        F.count_if(F.col("amount") != F.round("amount", C.AMOUNT_SCALE))
        .alias("amount_beyond_scale"),
    ]
    return tx.agg(*checks)


def customer_width_violations(customers: DataFrame) -> DataFrame:
    return customers.agg(F.count_if(F.length("external_id") > C.CUSTOMER_ID_MAX_LEN)
                         .alias("customer_id_too_long"))


def label_duplicates(snap, label: str) -> DataFrame:
    """C1 for one label of a store: its ids that occur twice in it, or in another label.

    Reads the label's own ids and, through the id index, only what other labels
    may hold of them, so a new label is audited at its own cost.
    """
    from . import id_index

    ids = snap.read("ids", runs=[snap.place[snap.current[label]]]).where(F.col("ingest_batch") == label)
    elsewhere = id_index.stored_ids(ids, id_index.STORED, snap, exclude_batch=label).withColumn("elsewhere", F.lit(True))
    count = ids.groupBy(id_index.STORED).agg(F.count(F.lit(1)).cast("int").alias("occurrences"))
    return (count.join(elsewhere, id_index.STORED, "left").withColumn("elsewhere", F.coalesce("elsewhere", F.lit(False)))
            .where((F.col("occurrences") > 1) | F.col("elsewhere")))


def label_orphans(snap, label: str) -> DataFrame:
    """C3 for one label: its customers without a customer row, from the label's summaries."""
    mine = snap.read("summaries", runs=[snap.place[snap.current[label]]]).where(F.col("ingest_batch") == label)
    return (mine.groupBy("customer_id").agg(F.sum("txn_count").alias("transactions"))
            .join(snap.read("customers").select(F.col("id").alias("customer_id")), "customer_id", "left_anti"))
