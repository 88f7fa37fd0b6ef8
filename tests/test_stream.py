"""Streaming ingest: same store however the input is cut into files and batches."""

from pyspark.sql import functions as F

from ledgerlake.plans.fixtures import FULL_LAYOUTS, write_csv_splits, write_json_splits
from ledgerlake.plans.ingest import run_ingest
from ledgerlake.plans.params import AS_OF
from ledgerlake.session import scratch_path
from ledgerlake.sources import files, store, tables
from ledgerlake.streaming.ingest_stream import ingest_stream

SF = "/root/testdata/sf0.001"


def accepted_ids(spark, root):
    return sorted(r[0] for r in store.read_transactions(spark, root)
                  .select("external_transaction_id").collect())


def test_stream_equals_batch_and_replay_is_noop(spark):
    raw = tables.raw_transactions(spark, SF)
    base = dict(base_transactions=tables.stored_transactions(spark, SF),
                base_customers=tables.customers(spark, SF))
    src = write_csv_splits(raw, "t-stream", FULL_LAYOUTS)

    # batch: all three files in one ingest
    batch_root = scratch_path(spark, "t-batch")
    run_ingest(files.read_csv_by_header(spark, src), batch_root, "all", AS_OF, **base)

    # stream: one file per micro-batch, then the whole stream again
    root = scratch_path(spark, "t-stream-store")
    ingest_stream(spark, src, root, scratch_path(spark, "ck"), as_of=AS_OF,
                  files_per_trigger=1, **base)
    first = accepted_ids(spark, root)
    ingest_stream(spark, src, root, scratch_path(spark, "ck"), as_of=AS_OF,
                  files_per_trigger=3, **base)
    assert accepted_ids(spark, root) == first
    assert first == accepted_ids(spark, batch_root)
    totals = store.running_counters(spark, root).first()
    assert totals.batches == 4 and totals.total_rows == 2 * raw.count()
    assert totals.accepted == len(first)


def test_stream_reads_only_files_of_admitted_size(spark, tmp_path, monkeypatch):
    from ledgerlake.streaming import ingest_stream as module
    for name, text in (("small.csv", "customerId,transactionId\nC,T\n"), ("big.CSV", "customerId\n" + "C\n" * 99),
                       ("empty.csv", ""), ("other.txt", "customerId\nC\n")):
        (tmp_path / name).write_text(text)
    seen = []
    monkeypatch.setattr(module, "run_ingest", lambda rows, *a, **k: seen.extend(
        r.source_file.rsplit("/", 1)[1] for r in rows.select("source_file").distinct().collect()))
    for cap in (50, None):
        module.ingest_stream(spark, str(tmp_path), "unused", scratch_path(spark, "ck"), files_per_trigger=9, max_bytes=cap)
    assert sorted(seen) == ["big.CSV", "small.csv", "small.csv"]
    admitted = files.admit_files(spark, str(tmp_path), 50).filter("admitted").collect()
    assert [r.path.rsplit("/", 1)[1] for r in admitted] == ["small.csv"]


def test_stream_files_follow_the_rows_not_their_numbers(spark):
    """Row numbers with wide gaps: as many files, and so micro-batches, as the rows need, in row order."""
    raw = tables.raw_transactions(spark, SF).withColumn("row_number", F.col("row_number") * 1_000_000 + 1)
    raw = raw.withColumn("row_number", F.col("row_number") - F.col("row_number") % 3 + F.col("row_number") % 7 % 3)
    count = [raw.filter(F.col("row_number") % 3 == i).count() for i in range(3)]
    for write, read in ((lambda n: write_csv_splits(raw, "t-sparse", FULL_LAYOUTS, n), files.read_csv_by_header),
                        (lambda n: write_json_splits(raw, "t-sparse", n), files.read_json_records)):
        whole = read(spark, write(10_000))
        assert whole.select("source_file").distinct().count() == 3
        cut = read(spark, write(max(count) // 2 + 1)).cache()
        assert cut.select("source_file").distinct().count() == sum(2 if n > max(count) // 2 + 1 else 1 for n in count)
        order = [[r.transactionId for r in x.orderBy("row_key").select("transactionId").collect()] for x in (whole, cut)]
        assert order[0] == order[1] and len(order[0]) == sum(count)


def test_stream_reads_the_base_once(spark, tmp_path, monkeypatch):
    """Batches look ids up in one staged column, not each in the whole base table; a file's rows are spread."""
    from ledgerlake.streaming import ingest_stream as module
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("customerId,transactionId\nC,T\n")
    seen, plans = [], []

    def taken(rows, *a, **k):
        seen.append(k["base_transactions"])
        plans.append(rows._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(module, "run_ingest", taken)
    base = tables.stored_transactions(spark, SF)
    module.ingest_stream(spark, str(tmp_path), "unused", scratch_path(spark, "ck"), base_transactions=base)
    assert len(seen) == 2 and all(x.columns == ["external_transaction_id"] for x in seen)
    assert {f for x in seen for f in x.inputFiles()}.isdisjoint(base.inputFiles())
    assert sorted(seen[0].collect()) == sorted(base.select("external_transaction_id").collect())
    assert all("hashpartitioning(row_key" in p for p in plans)      # a file's rows are validated by many tasks
