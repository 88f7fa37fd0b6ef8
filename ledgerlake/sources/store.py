"""The Parquet store: transactions, customers, rejects and counters.

Layout under one root folder::

    <table>/run=<run>/...            rows a run wrote; every row carries its ingest_batch (label)
    transactions/run=<run>/txn_month=<yyyy-MM>/part-*.parquet
    ids/run=<run>/                   transaction ids by hash bucket; id_filters/run=<run>/ beside them
    summaries/run=<run>/             counts and totals by customer, day, currency and channel
    files/run=<run>/                 ranges (customers, hash buckets) and row count of each file
    commits/                         one row a commit: what readers resolve everything through

**Commits.** A run writes all its tables into folders of its own, which no
reader knows yet. One row appended to ``commits`` (a single file that becomes
visible by one rename) makes all of them visible at once; a run that fails
before leaves the old state as it was. A label's newest run is its current one,
so a replay replaces the label as a whole, also when the new output is empty.
Customers are the exception: a run carries on those its label created before,
since rows of other batches may refer to them. One writer a store at a time.

**Compaction** folds the current rows of some labels into one run, sorted by
month, customer and date, with few files and narrow customer ranges. Rows keep
their label, so a label can be replayed afterwards: its rows in the compacted
run are then skipped by a filter on (run, label). ``vacuum`` deletes what no
commit refers to any more.

``txn_month`` gives partition pruning to date-range queries, and the file
statistics let a customer's page open only files whose range holds the customer.
Labels, months and runs are strings by schema, whatever they look like.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from .tables import CUSTOMER_COLUMNS, TRANSACTION_COLUMNS

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("external_transaction_id", T.StringType()),
    T.StructField("transaction_date", T.TimestampNTZType()),
    T.StructField("amount", T.DecimalType(18, 4)),
    T.StructField("currency", T.StringType()),
    T.StructField("source_channel", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])
CUSTOMER_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("external_id", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])
REJECT_SCHEMA = ("source_file string, row_number bigint, transactionId string, status string, "
                 "errors array<struct<field:string,code:string,message:string>>")
COUNTERS = ("total_rows", "accepted", "rejected", "duplicate", "invalid", "unresolved")
SUMMARY_KEYS = ("customer_id", "txn_day", "currency", "source_channel")

#: Columns of each table in its files, without the label; and its partition folders below the run.
SCHEMAS = {
    "transactions": TRANSACTION_SCHEMA,
    "customers": CUSTOMER_SCHEMA,
    "rejects": REJECT_SCHEMA,
    "counters": ", ".join(f"{c} bigint" for c in COUNTERS),
    "ids": "bucket int, external_transaction_id string",
    "id_filters": "bucket int, block bigint, " + ", ".join(f"w{i} bigint" for i in range(8)),
    "summaries": f"customer_id string, txn_day date, currency string, source_channel string, txn_count bigint, "
                 f"total_amount {C.SUM_DECIMAL}, oldest timestamp_ntz, newest timestamp_ntz",
    "files": "table string, file string, first string, last string, file_rows bigint",
}
#: Column whose range the file statistics give; text, so buckets are written with leading zeros.
RANGED = {"transactions": "customer_id", "ids": "bucket", "id_filters": "bucket"}
LOG = "version bigint, kind string, label string, run string, blocks bigint, folded array<struct<label:string,run:string>>"


def _path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


# -- commits ----------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Snapshot:
    """What a reader sees: every read through one snapshot is of one commit."""
    spark: SparkSession
    root: str
    version: int = 0
    current: dict = field(default_factory=dict)      # label -> its newest run
    place: dict = field(default_factory=dict)        # run of a label -> the run whose folders hold its rows
    blocks: dict = field(default_factory=dict)       # run -> filter blocks in each bucket of its id index
    labels: dict = field(default_factory=dict)       # run -> the labels that have rows in its folders

    def runs(self, exclude_batch: str | None = None) -> dict[str, list[str]]:
        """Runs to read, each with the labels whose rows in it don't count (any more)."""
        held: dict[str, set] = {}
        for label, run in self.current.items():
            held.setdefault(self.place[run], set())
            if label != exclude_batch:
                held[self.place[run]].add(label)
        return {run: sorted(self.labels[run] - good) for run, good in held.items() if good}

    def read(self, table: str, exclude_batch: str | None = None, runs: list[str] | None = None,
             files: list[str] | None = None) -> DataFrame:
        """Rows of a table with ``ingest_batch`` and ``run``; only of some runs or files, if given."""
        schema = SCHEMAS[table]
        schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        extra = [T.StructField("ingest_batch", T.StringType()), T.StructField("run", T.StringType())]
        if table == "transactions":
            extra.append(T.StructField("txn_month", T.StringType()))
        full = T.StructType([*schema.fields, *extra])
        live = {r: stale for r, stale in self.runs(exclude_batch).items() if runs is None or r in runs}
        base = _path(self.root, table)
        paths = [f"{base}/run={r}" for r in live] if files is None else [f"{base}/{f}" for f in files]
        if not paths or not live:
            return self.spark.createDataFrame([], full)
        df = self.spark.read.schema(full).option("basePath", base).parquet(*paths)
        stale = [(r, labels) for r, labels in live.items() if labels]
        if table not in ("id_filters", "files"):      # these are of a whole run
            for run, labels in stale:
                df = df.where(~((F.col("run") == run) & F.col("ingest_batch").isin(labels)))
        return df


def snapshot(spark: SparkSession, root: str) -> Snapshot:
    """The newest commit. The log has one small row a commit, read whole."""
    try:
        rows = spark.read.schema(LOG).parquet(_path(root, "commits")).orderBy("version").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":       # only a missing log is an empty store
            raise
        rows = []
    current, place, blocks, labels = {}, {}, {}, {}
    for r in rows:
        blocks[r.run] = r.blocks or 1
        if r.kind == "label":
            current[r.label] = r.run
            place[r.run] = r.run
            labels[r.run] = {r.label}
        else:
            labels[r.run] = {f.label for f in r.folded}
            place |= {f.run: r.run for f in r.folded}
    return Snapshot(spark, root, rows[-1].version if rows else 0, current, place, blocks, labels)


def _commit(snap: Snapshot, kind: str, run: str, label: str | None = None, blocks: int = 1, folded=None) -> None:
    row = (snap.version + 1, kind, label, run, blocks, folded)
    snap.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(_path(snap.root, "commits"))


# -- writing a run ----------------------------------------------------------------------------------------------

def month_of(ts: str = "transaction_date") -> Column:
    return F.date_format(F.col(ts), "yyyy-MM")


class Run:
    """One run of a label (or of a compaction): writes folders that no reader sees before ``commit``."""

    def __init__(self, spark: SparkSession, root: str, label: str | None = None):
        self.spark, self.root, self.label = spark, root, label
        self.name, self.blocks = uuid.uuid4().hex, 1

    def path(self, table: str) -> str:
        return f"{_path(self.root, table)}/run={self.name}"

    def write(self, df: DataFrame, table: str) -> None:
        if self.label is not None:
            df = df.withColumn("ingest_batch", F.lit(self.label))
        out = df.write.mode("overwrite")
        if table == "transactions":
            out = out.partitionBy("txn_month")
        out.parquet(self.path(table))

    def transactions(self, accepted: DataFrame) -> None:
        """One path for any batch size; duplicates were removed upstream.

        Rows are range-partitioned and sorted by month, customer and date, so a
        hot customer spreads over several files. The id index, the summaries and
        the file statistics are made from the rows as written.
        """
        from ..operators import id_index, summaries

        order = ("txn_month", "customer_id", "transaction_date", "id")
        self.write(accepted.withColumn("txn_month", month_of()).repartitionByRange(*order)
                   .sortWithinPartitions(*order), "transactions")
        schema = T.StructType([*TRANSACTION_SCHEMA.fields, T.StructField("ingest_batch", T.StringType()),
                               T.StructField("txn_month", T.StringType())])
        rows = self.spark.read.schema(schema).parquet(self.path("transactions"))
        labels = rows if self.label is None else rows.drop("ingest_batch")
        self.write(summaries.partial_summaries(labels).sortWithinPartitions("customer_id", "txn_day"), "summaries")
        n = rows.count()
        self.blocks = id_index.blocks_for(n)
        self.write(id_index.index_rows(labels, n), "ids")
        ids = self.spark.read.schema(f"{id_index.STORED} string").parquet(self.path("ids"))
        self.write(id_index.filter_rows(ids, self.blocks), "id_filters")
        self.write(reduce(DataFrame.unionByName, [self._ranges(t) for t in RANGED]), "files")

    def _ranges(self, table: str) -> DataFrame:
        """Smallest and largest value of the ranged column in each file of a table."""
        col = RANGED[table]
        kind = "string" if col == "customer_id" else "int"
        rows = self.spark.read.schema(f"{col} {kind}").parquet(self.path(table))
        file = F.regexp_extract(F.col("_metadata.file_path"), f"/{table}/(run=.*)$", 1)
        found = (rows.select(file.alias("file"), F.col(col).alias("v")).groupBy("file")
                 .agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count("*").alias("file_rows")))
        if col == "bucket":                          # numbers until here: their least and greatest need no sort
            found = found.withColumns({c: F.lpad(c, 8, "0") for c in ("first", "last")})
        return (found
                .withColumns({"table": F.lit(table), "ingest_batch": F.lit(None).cast("string")}))

    def commit(self, folded=None) -> None:
        _commit(snapshot(self.spark, self.root), "label" if self.label is not None else "compact",
                self.name, self.label, self.blocks, folded)


def write_customers(run: Run, created: DataFrame) -> None:
    """The label's customers: those created now and those of an earlier run of the label."""
    snap = snapshot(run.spark, run.root)
    old = snap.read("customers").where(F.col("ingest_batch") == run.label)
    run.write(old.select(*CUSTOMER_COLUMNS).unionByName(created.select(*CUSTOMER_COLUMNS))
              .groupBy("id", "external_id").agg(F.min("created_at").alias("created_at")), "customers")


def write_rejects(run: Run, rejects: DataFrame) -> None:
    """Rejected rows with their errors, kept as a table."""
    for name, kind in (("source_file", "string"), ("row_number", "bigint")):
        if name not in rejects.columns:
            rejects = rejects.withColumn(name, F.lit(None).cast(kind))
    run.write(rejects.withColumn("row_number", F.col("row_number").cast("bigint")), "rejects")


def write_counters(run: Run, counters: DataFrame) -> None:
    run.write(counters, "counters")


def load_label(transactions: DataFrame, customers: DataFrame, root: str, label: str) -> None:
    """Bulk load of rows that are known to be good (history from elsewhere) as one label."""
    spark = transactions.sparkSession
    run = Run(spark, root, label)
    write_customers(run, customers)
    run.transactions(transactions.select(*TRANSACTION_COLUMNS))
    run.write(spark.createDataFrame([], REJECT_SCHEMA), "rejects")
    run.write(spark.createDataFrame([], SCHEMAS["counters"]), "counters")
    run.commit()


# -- reading ----------------------------------------------------------------------------------------------------

def read_transactions(spark: SparkSession, root: str, exclude_batch: str | None = None,
                      with_partitions: bool = True) -> DataFrame:
    """Stored rows; with label and month, so that the page filters prune months."""
    df = snapshot(spark, root).read("transactions", exclude_batch)
    return df.select(*TRANSACTION_COLUMNS, *(("ingest_batch", "txn_month") if with_partitions else ()))


def read_customers(spark: SparkSession, root: str, exclude_batch: str | None = None) -> DataFrame:
    """Stored customers. Two labels may have created the same one; ids follow from external ids."""
    return snapshot(spark, root).read("customers", exclude_batch).select(*CUSTOMER_COLUMNS)


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    return snapshot(spark, root).read("rejects").drop("run")


def running_counters(spark: SparkSession, root: str) -> DataFrame:
    """Totals over all batches (a replay replaces its batch's row, it is not added)."""
    c = snapshot(spark, root).read("counters")
    return c.agg(*[F.sum(x).cast("bigint").alias(x) for x in COUNTERS],
                 F.countDistinct("ingest_batch").alias("batches"))


def customer_transactions(snap: Snapshot, customer_id: str) -> DataFrame:
    """Rows of one customer, read from the files whose customer range holds it."""
    # the paths of one customer's files: a customer's rows are sorted together in each run and month
    found = (snap.read("files").where((F.col("table") == "transactions") & (F.col("first") <= customer_id)
                                      & (F.col("last") >= customer_id)).select("file").collect())
    rows = snap.read("transactions", files=[r.file for r in found])
    return rows.where(F.col("customer_id") == customer_id).select(*TRANSACTION_COLUMNS, "ingest_batch", "txn_month")


# -- upkeep -----------------------------------------------------------------------------------------------------

def compact(spark: SparkSession, root: str, labels: list[str] | None = None) -> str | None:
    """Fold the current rows of some labels (default: those not folded yet) into one run."""
    snap = snapshot(spark, root)
    if labels is None:
        labels = [x for x, run in snap.current.items() if snap.place[run] == run]
    folded = [(x, snap.current[x]) for x in labels if x in snap.current]
    if not folded:
        return None
    mine = F.col("ingest_batch").isin([x for x, _ in folded])
    run = Run(spark, root)
    run.transactions(snap.read("transactions").where(mine).select(*TRANSACTION_COLUMNS, "ingest_batch"))
    for table, order in (("customers", "id"), ("rejects", "ingest_batch"), ("counters", "ingest_batch")):
        rows = snap.read(table).where(mine).drop("run")
        run.write(rows.repartitionByRange(order).sortWithinPartitions(order), table)
    run.commit(folded)
    return run.name


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete runs that no reader of the newest commit needs; returns their names."""
    keep, gone = set(snapshot(spark, root).runs()), set()
    for table in SCHEMAS:
        base = spark._jvm.org.apache.hadoop.fs.Path(_path(root, table))
        fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(base) if fs.exists(base) else []:
            name = status.getPath().getName()
            if name.startswith("run=") and name[4:] not in keep:
                fs.delete(status.getPath(), True)
                gone.add(name[4:])
    return sorted(gone)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later read needs."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
