"""Customer get-or-create and key resolution.

Set-wise: the distinct external ids of a batch are matched against the
customers table once. The customers table is reduced to the batch's ids by
a semi join before anything else touches it, so work is bounded by the
batch. New customers get a deterministic id (md5 of the external id) and
the batch clock as ``created_at``; existing customers keep both values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.parsing import surrogate_id

CUST = "customerId"


def distinct_customers(rows: DataFrame, col: str = CUST) -> DataFrame:
    """Distinct external customer ids of a set of rows."""
    return rows.select(F.col(col).alias("external_id")).distinct()


def matching_customers(wanted: DataFrame, customers: DataFrame) -> DataFrame:
    """Stored customers whose external id is in ``wanted`` (one column ``external_id``)."""
    return customers.select("id", "external_id", "created_at") \
        .join(wanted, "external_id", "left_semi")


def missing_customers(wanted: DataFrame, customers: DataFrame) -> DataFrame:
    """Wanted external ids not yet in the customers table."""
    return wanted.join(customers.select("external_id"), "external_id", "left_anti")


def get_or_create(wanted: DataFrame, customers: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Returns (resolved, created).

    ``resolved`` has one row per wanted external id (existing ∪ new);
    ``created`` is the new part, to be appended to the customers table.
    """
    existing = matching_customers(wanted, customers)
    created = (missing_customers(wanted, customers)
               .select(surrogate_id(F.col("external_id")).alias("id"), "external_id",
                       now.alias("created_at")))
    return existing.unionByName(created), created


def resolve_or_assign(rows: DataFrame, customers: DataFrame, col: str = CUST,
                      key_when: Column | None = None, spread_col: str | None = None
                      ) -> DataFrame:
    """J6 + S10 in one left join: ``customer_id`` of a stored customer, else the
    new deterministic id; ``customer_is_new`` marks the second case.

    The join is on the external id; Catalyst/AQE broadcast the customers side
    only when its measured size is under the threshold, else both sides are
    hash-partitioned (a hot customer is split by AQE skew handling).

    Rows where ``key_when`` is false are not looked up: their ``customer_id``
    stays null. Their join key is made longer than any valid external id
    (so it matches nothing) and unique per row via ``spread_col``, so these
    rows spread over all tasks instead of sharing the null key's one task.
    """
    known = customers.select(F.col("external_id").alias("_ext"), F.col("id").alias("_known_id"))
    if key_when is None:
        wanted, lookup = F.col(col).isNotNull(), F.col(col)
    else:
        no_match = F.concat(F.lit("~" * (C.CUSTOMER_ID_MAX_LEN + 1)),
                            F.col(spread_col).cast("string") if spread_col else F.lit(""))
        wanted, lookup = key_when, F.when(key_when, F.col(col)).otherwise(no_match)
    keyed = rows.withColumns({"_lookup": lookup, "_wanted": wanted})
    joined = keyed.join(known, keyed["_lookup"] == known["_ext"], "left")
    is_new = F.col("_wanted") & F.col("_known_id").isNull()
    assigned = F.coalesce(F.col("_known_id"), surrogate_id(F.col(col)))
    return (joined.withColumn("customer_is_new", is_new)
            .withColumn("customer_id", F.when(F.col("_wanted"), assigned))
            .drop("_known_id", "_ext", "_lookup", "_wanted"))


def created_customers(classified: DataFrame, now: Column, col: str = CUST) -> DataFrame:
    """New customers of accepted rows, one row each (id, external_id, created_at)."""
    return (classified.filter((F.col("status") == C.STATUS_ACCEPTED) & F.col("customer_is_new"))
            .select(F.col("customer_id").alias("id"), F.col(col).alias("external_id"))
            .distinct()
            .withColumn("created_at", now))


def unresolved_error(col: str = CUST) -> Column:
    msg = F.replace(F.lit(C.MSG_CUSTOMER_UNRESOLVED), F.lit("{customer}"), F.col(col))
    return F.struct(F.lit(col).alias("field"), F.lit(C.ERR_CUST_UNRESOLVED).alias("code"),
                    msg.alias("message"))
