"""Inline relation from parallel arrays.

The original sends a set of new customers as three parallel arrays and
turns them back into rows with ``UNNEST``. ``unnest_parallel_arrays`` is
that operation on a DataFrame of array columns (``arrays_zip`` + ``inline``,
a generator that runs inside the task). ``chunked_parallel_arrays`` builds
such arrays from rows in chunks of a bounded number of rows (the original's
500-row chunks), so no array grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C


def chunked_parallel_arrays(df: DataFrame, cols: tuple[str, ...],
                            chunk_rows: int = C.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """One row per chunk of at most ``chunk_rows`` rows, one array per column.

    A chunk is a run of consecutive rows of one partition
    (``monotonically_increasing_id`` div ``chunk_rows``), so its size bound
    holds whatever the data; the arrays are aligned because they come from
    one list of structs.
    """
    chunk = F.floor(F.monotonically_increasing_id() / chunk_rows).alias("chunk")
    rows = df.groupBy(chunk).agg(F.collect_list(F.struct(*cols)).alias("_rows"))
    return rows.select("chunk", *[F.transform("_rows", _field(c)).alias(c) for c in cols])


def _field(name: str):
    return lambda r: r[name]


def unnest_parallel_arrays(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """``UNNEST(a, b, c)``: the i-th elements of the arrays form the i-th row."""
    zipped = F.arrays_zip(*[F.col(c) for c in cols])
    return df.select(F.inline(zipped)).select(*cols)
