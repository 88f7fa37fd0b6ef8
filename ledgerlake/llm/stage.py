"""Lineage cuts: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="stage-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stage(df: DataFrame, name: str, rows_a_batch: int | None = None) -> DataFrame:
    """Write ``df`` once and read it back; later jobs start from the written table.

    ``rows_a_batch`` bounds the rows that reach a Python worker at once while it is
    written: whole texts in batches of the usual size take much of an executor's memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(BATCH)
    if rows_a_batch:
        spark.conf.set(BATCH, str(rows_a_batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete staged tables that no later job reads."""
    for t in tables:
        path = getattr(t, "staged_path", None)
        if path:
            jvm = t.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key():
    """16-byte identity of a text; null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def word_array(text):
    """Words between ASCII white space; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORDS), lambda w: w != "")
