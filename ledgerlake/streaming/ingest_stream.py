"""Streaming ingest (R1-R6): file streams feed the batch ingest function.

The original reads an upload in 500-row chunks and runs validate -> dedupe
-> customers -> append per chunk. Here a Structured Streaming query watches
an input folder; each micro-batch (bounded by ``maxFilesPerTrigger``) names
the new files, and ``foreachBatch`` runs exactly the batch job
(``run_ingest``) over them, with the micro-batch id as the store partition
label. A replayed micro-batch rewrites its own partition and excludes it
from duplicate detection, so the store is the same whether a batch ran once
or twice, and the same however the input was cut into files or batches
(counters per batch differ, totals of accepted rows do not).

The stream itself only carries file paths (the ``binaryFile`` source with
the content column pruned); the file contents are read by the batch
sources, which map CSV columns by header, which a streaming CSV source with
a fixed schema cannot do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ingest import run_ingest
from ..session import scratch_path
from ..sources import files


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def batch_label(stream: str, batch_id: int) -> str:
    """Store partition of one micro-batch: stable across restarts of the same
    query (same checkpoint), distinct between queries that share a store."""
    return f"s{stream}-{batch_id:012d}"


def ingest_stream(spark: SparkSession, input_dir: str, root: str, checkpoint: str,
                  fmt: str = "csv", as_of: str | None = None, files_per_trigger: int = 1,
                  base_transactions: DataFrame | None = None,
                  base_customers: DataFrame | None = None,
                  timeout_s: int | None = None, max_bytes: int | None = None) -> None:
    """Run the stream until the input folder is drained (``availableNow``).

    Files of another extension, empty ones and, if ``max_bytes`` is given, longer ones
    are never read; ``files.admit_files`` over the folder lists them with the reason.

    ``base_*`` are stored tables outside ``root``; their ids are read once a start, not once a batch.

    There is no time limit unless ``timeout_s`` sets one. On a cluster, drop
    ``availableNow`` and keep the query running; the per-batch function is the same.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"unsupported format {fmt}")
    if files_per_trigger <= 0:
        raise ValueError("files_per_trigger must be greater than 0")
    # the extension counts in any case
    glob = "*.[cC][sS][vV]" if fmt == "csv" else "*.[jJ][sS][oO][nN]"
    paths = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
             .option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", files_per_trigger).load(input_dir)
             .select("path", "length"))

    if base_transactions is not None:
        held = scratch_path(spark, "base-ids")
        base_transactions.select("external_transaction_id").write.parquet(held)
        base_transactions = spark.read.parquet(held)
    stream = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # the file list of one micro-batch: bounded by maxFilesPerTrigger
        fits = F.col("length") > 0
        if max_bytes is not None:
            fits &= F.col("length") <= max_bytes
        names = [r.path for r in batch.filter(fits).select("path").collect()]
        if not names:
            return
        reader: Callable = files.read_csv_by_header if fmt == "csv" else files.read_json_records
        rows = reader(spark, names)
        if fmt == "csv":
            # a task reads a whole file; its rows are spread for parsing and validation
            rows = rows.repartition("row_key")
        run_ingest(rows, root, batch_label(stream, batch_id), as_of=as_of, typed=(fmt == "json"),
                   base_transactions=base_transactions, base_customers=base_customers)

    q = (paths.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    try:
        finished = q.awaitTermination(timeout_s) if timeout_s else q.awaitTermination()
        if finished is False:
            raise TimeoutError(f"stream over {input_dir} did not finish in {timeout_s}s")
    finally:
        if q.isActive:
            q.stop()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
