"""Joining rows back to a one-row-per-key table without a hot task.

When one key holds a large share of the rows (a transaction id repeated
across a batch, a blank id on many invalid rows), a plain hash join sends all
of that key's rows to one task. ``split_hot_keys_join`` finds the hot keys
from the per-key row counts the aggregate already produced, spreads each hot
key's rows over ``fanout`` salts, and copies the key's single row on the
small side once per salt. Cold keys keep salt 0 and move exactly as before.

A key is hot when it holds more than ``max(min_rows, total / max_hot_keys)``
rows, so there are at most ``max_hot_keys`` of them: the hot-key list that
is broadcast has a fixed upper size, whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_hot_keys_join(big: DataFrame, small: DataFrame, key: str, rows_col: str,
                        spread_col: str, fanout: int = 16, min_rows: int = 100_000,
                        max_hot_keys: int = 1000) -> DataFrame:
    """Left join ``big`` to ``small`` (one row per ``key``, with its row count
    in ``rows_col``), splitting hot keys across ``fanout`` tasks by a hash of
    ``spread_col``. Output: big's columns plus small's, without helpers."""
    total = small.agg(F.coalesce(F.sum(rows_col), F.lit(0)).alias("_total"))
    limit = F.greatest(F.lit(min_rows), total.scalar() / max_hot_keys)
    hot = (small.filter(F.col(rows_col) > limit).select(key)
           .withColumn("_hot", F.lit(True)))
    tagged = big.join(F.broadcast(hot), key, "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_col), F.lit(fanout))) \
        .otherwise(F.lit(0)).cast("int")
    salted_big = tagged.withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col(rows_col) > limit, F.sequence(F.lit(0), F.lit(fanout - 1))) \
        .otherwise(F.array(F.lit(0)))
    salted_small = small.withColumn("_salt", F.explode(copies))
    return salted_big.join(salted_small, [key, "_salt"], "left").drop("_salt", rows_col)
