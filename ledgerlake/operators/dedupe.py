"""Duplicate detection against the store and inside a batch.

The store can be far larger than a batch: its id column is first semi-joined
with the batch's ids (Catalyst broadcasts the id side when its estimate is
small, otherwise the id column is scanned and hash-partitioned whole), which
bounds every later step by the batch size.

In-batch duplicates use an aggregate (min over an ordering struct), which
Spark pre-aggregates map-side, instead of a window: a transaction id that
repeats in a third of the batch is then folded before the shuffle, and the
join back is arranged so that AQE can split it (``plans/ingest.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C

ID = "transactionId"


def _stored_hits(batch: DataFrame, store: DataFrame, id_col: str) -> DataFrame:
    """Store ids that occur in the batch (bounded by the batch, not the store)."""
    ids = store.select(F.col("external_transaction_id").alias(id_col))
    return ids.join(batch.select(id_col), id_col, "left_semi")


def existing_ids(batch: DataFrame, store: DataFrame, id_col: str = ID) -> DataFrame:
    """Distinct batch ids already present in the store."""
    return _stored_hits(batch, store, id_col).distinct()


def new_rows(batch: DataFrame, store: DataFrame, id_col: str = ID) -> DataFrame:
    """Batch rows whose id is not stored yet."""
    ids = store.select(F.col("external_transaction_id").alias(id_col))
    return batch.join(ids, id_col, "left_anti")


def exists_flags(batch: DataFrame, store: DataFrame, id_col: str = ID) -> DataFrame:
    """Every batch row with a boolean ``exists`` (set-wise EXISTS per id)."""
    hits = _own_exchange(existing_ids(batch, store, id_col), id_col).withColumn("exists", F.lit(True))
    return (batch.join(hits, id_col, "left")
            .withColumn("exists", F.coalesce(F.col("exists"), F.lit(False))))


def _own_exchange(per_id: DataFrame, id_col: str) -> DataFrame:
    """A per-id aggregate under a new key, so that a join onto it is one of two plain
    shuffles: AQE splits a hot id's partition there, but not in a join onto an aggregate."""
    return per_id.withColumn(id_col, F.concat(id_col, F.lit("")))


ORDER_KEY = "row_key"


def first_occurrence(candidates: DataFrame, store: DataFrame | None,
                     order_col: str = ORDER_KEY, id_col: str = ID) -> DataFrame:
    """W3 + J2 in one aggregate: per id, who owns it.

    Returns (id, ``_owner``, ``_rows``): the smallest ingest-order key among the
    batch's rows with that id, or -1 when the id is already stored. A batch
    row is accepted iff the owner is its own key. The key is a ``bigint`` so
    the aggregate stays a hash aggregate with a map-side partial step.
    """
    # rows whose order key is null (e.g. invalid rows) take part in no
    # ownership: min() ignores them
    mine = candidates.select(id_col, F.col(order_col).cast("bigint").alias("_key"),
                             F.lit(1).alias("_one"))
    parts = mine
    if store is not None:
        stored = _stored_hits(candidates, store, id_col)
        parts = stored.select(id_col, F.lit(-1).cast("bigint").alias("_key"),
                              F.lit(0).alias("_one")).unionByName(mine)
    # _rows (batch rows per id) lets the join back find hot ids
    return parts.groupBy(id_col).agg(F.min("_key").alias("_owner"),
                                     F.sum("_one").cast("bigint").alias("_rows"))


def mark_duplicates(valid: DataFrame, store: DataFrame | None,
                    order_col: str = ORDER_KEY, id_col: str = ID) -> DataFrame:
    """Adds ``dup_code``: null (first valid occurrence), dup_stored or dup_batch."""
    owners = _own_exchange(first_occurrence(valid, store, order_col, id_col), id_col)
    code = (F.when(F.col("_owner") == -1, F.lit(C.ERR_DUP_STORED))
            .when(F.col("_owner") != F.col(order_col), F.lit(C.ERR_DUP_BATCH)))
    return (valid.join(owners, id_col, "inner").withColumn("dup_code", code)
            .drop("_owner", "_rows"))
