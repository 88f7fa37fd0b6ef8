"""Commits, compaction, the id index, summaries and seek pages of the store."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import audit, dedupe, id_index, paging, summaries
from ledgerlake.plans import ingest
from ledgerlake.plans.ingest import run_ingest
from ledgerlake.sources import store

AS_OF = "2024-06-01 00:00:00"


def batch(spark, *rs):
    return spark.createDataFrame([(i, c, t, "2024-05-01T00:00:00Z", a, "USD", "web") for i, (c, t, a) in enumerate(rs)],
                                 "row_key bigint, customerId string, transactionId string, transactionDate string, "
                                 "amount string, currency string, sourceChannel string")


def history(spark, n, seed=0, hot=0.5):
    """Stored rows; customer k1 has about half of them."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"id{seed}-{i:05d}", "k1" if rng.random() < hot else f"k{rng.randint(2, 9)}", f"T{seed}-{i:05d}",
             start + dt.timedelta(minutes=rng.randint(0, 200 * 24 * 60) // 60 * 60), rng.randint(1, 9999),
             rng.choice(["USD", "EUR"]), rng.choice(["web", "pos"]), start) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, customer_id string, external_transaction_id string, transaction_date timestamp_ntz, "
                                     "amount bigint, currency string, source_channel string, created_at timestamp_ntz")
    return df.withColumn("amount", F.col("amount").cast("decimal(18,4)"))


def people(spark):
    return spark.createDataFrame([(f"k{i}", f"CUST-{i}", None) for i in range(1, 10)], store.CUSTOMER_SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.select(*store.TRANSACTION_COLUMNS).collect()))


@pytest.fixture(scope="module")
def ledger(spark, tmp_path_factory):
    """h0 and h1 (wrong) compacted, h1 replayed, h2 new; and the rows that count."""
    root = str(tmp_path_factory.mktemp("ledger"))
    part = [history(spark, n, seed) for seed, n in ((0, 400), (1, 300), (2, 200))]
    none = people(spark).where("false")
    store.load_label(part[0], people(spark), root, "h0")
    store.load_label(part[1].withColumn("currency", F.lit("XXX")), none, root, "h1")
    store.compact(spark, root)
    store.load_label(part[1], none, root, "h1")
    store.load_label(part[2], none, root, "h2")
    return root, part[0].unionByName(part[1]).unionByName(part[2])


def test_failed_run_leaves_the_old_state(spark, tmp_dir, monkeypatch):
    run_ingest(batch(spark, ("C1", "T1", "1"), ("C1", "T2", "2")), tmp_dir, "b1", AS_OF)
    before = store.snapshot(spark, tmp_dir)
    seen = rows_of(store.read_transactions(spark, tmp_dir))

    def fails(*_):
        raise OSError("no space")

    monkeypatch.setattr(store, "write_rejects", fails)           # transactions are written, rejects are not
    with pytest.raises(OSError):
        run_ingest(batch(spark, ("C9", "T1", "5"), ("C9", "", "5")), tmp_dir, "b1", AS_OF)
    monkeypatch.undo()
    after = store.snapshot(spark, tmp_dir)
    assert (after.version, after.current) == (before.version, before.current)
    assert rows_of(store.read_transactions(spark, tmp_dir)) == seen
    assert store.read_rejects(spark, tmp_dir).count() == 0
    assert [r[0] for r in store.read_customers(spark, tmp_dir).select("external_id").collect()] == ["C1"]
    assert len(store.vacuum(spark, tmp_dir)) == 1                # what the failed run left
    run_ingest(batch(spark, ("C9", "T1", "5"), ("C9", "", "5")), tmp_dir, "b1", AS_OF)
    assert [r[0] for r in store.read_transactions(spark, tmp_dir).select("external_transaction_id").collect()] == ["T1"]
    assert store.running_counters(spark, tmp_dir).first().invalid == 1


def test_replayed_label_inside_a_compacted_run(spark, ledger):
    root, want = ledger
    snap = store.snapshot(spark, root)
    assert rows_of(snap.read("transactions")) == rows_of(want)
    assert len(snap.runs()) == 3 and sorted(map(tuple, snap.runs().values())) == [(), (), ("h1",)]
    assert rows_of(snap.read("transactions", exclude_batch="h0")) == rows_of(want.where(~F.col("id").startswith("id0")))
    assert snap.read("customers").count() == 9


def test_statistics_equal_a_scan(spark, ledger):
    root, want = ledger
    snap = store.snapshot(spark, root)
    total = summaries.stats_total(snap).first()
    plain = want.agg(F.count("*"), F.countDistinct("customer_id"), F.min("transaction_date"), F.max("transaction_date")).first()
    assert tuple(total) == tuple(plain)
    by = want.groupBy("currency").agg(F.count("*"), F.sum("amount")).orderBy("currency").collect()
    assert [tuple(r) for r in summaries.stats_by_currency(snap).collect()] == [tuple(r) for r in by]
    assert abs(summaries.approx_customers(snap).first()[0] - 9) <= 1


@pytest.mark.parametrize("kw", [dict(), dict(currency="EUR"), dict(from_date="2024-02-03 05:00:00", to_date="2024-05-07 13:00:00")])
def test_seek_pages_equal_offset_pages(spark, ledger, kw):
    root, want = ledger
    snap = store.snapshot(spark, root)
    base = dict(from_date="2024-01-01 00:00:00", to_date="2024-12-31 00:00:00", page_size=30) | kw
    cursor, cols = None, [c for c in paging.ITEM_COLUMNS]
    for page in (1, 2, 7, 40):
        req = paging.PageRequest("CUST-1", page=page, **base)
        plain = paging.customer_page(want, people(spark), req)
        sought = [tuple(r) for r in summaries.seek_page(snap, req).select(*cols).collect()]
        assert sought == [tuple(r) for r in plain.items.select(*cols).collect()]
        if page <= 2:
            rows = summaries.page_after(snap, req, cursor).collect()
            assert [tuple(r[c] for c in cols) for r in rows] == sought
            cursor = (str(rows[-1].transaction_date), rows[-1].id)
    assert tuple(summaries.page_total(snap, req).first()) == tuple(plain.info.first())


def test_id_index_opens_few_files(spark, ledger):
    root, want = ledger
    snap = store.snapshot(spark, root)
    ask = want.select("external_transaction_id").where("external_transaction_id LIKE '%7'")
    new = spark.createDataFrame([(f"N{i}",) for i in range(300)] + [(None,)], "external_transaction_id string")
    got = id_index.stored_ids(ask.unionByName(new).unionByName(ask), "external_transaction_id", snap)
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in ask.collect())
    fresh = id_index.stored_ids(new, "external_transaction_id", snap)
    assert fresh.count() == 0 and len(fresh.inputFiles()) <= 3
    one = spark.createDataFrame([("T2-00005",)], "external_transaction_id string")
    found = id_index.stored_ids(one, "external_transaction_id", snap)
    run = snap.current["h2"]
    assert found.count() == 1 and sum(f"/ids/run={run}/" in f for f in found.inputFiles()) == 1
    assert id_index.stored_ids(one, "external_transaction_id", snap, exclude_batch="h2").count() == 0


def test_filter_has_no_false_negatives(spark):
    ids = spark.range(5000).select(F.concat(F.lit("X"), "id").alias("external_transaction_id"))
    blocks = id_index.blocks_for(5000)
    rows = id_index.filter_rows(ids, blocks)
    h = F.xxhash64("external_transaction_id")
    test = " AND ".join(f"getbit(w{i}, b{i}) = 1" for i in range(8))

    def passing(df):
        probe = df.select(id_index._bucket(h).alias("bucket"), id_index._block(h, F.lit(blocks)).alias("block"),
                          *id_index._bits(F.col("external_transaction_id")))
        return probe.join(rows.drop("ingest_batch"), ["bucket", "block"]).where(test).count()

    assert passing(ids) == 5000
    assert passing(spark.range(5000).select(F.concat(F.lit("Y"), "id").alias("external_transaction_id"))) < 100


def test_label_audits(spark, tmp_dir):
    good, bad = history(spark, 50, 1), history(spark, 30, 2)
    store.load_label(good, people(spark).where("id <> 'k1'"), tmp_dir, "good")
    store.load_label(bad.unionByName(bad.limit(1)).unionByName(good.where("id = 'id1-00007'")), people(spark).where("false"), tmp_dir, "bad")
    snap = store.snapshot(spark, tmp_dir)
    found = {tuple(r) for r in audit.label_duplicates(snap, "bad").collect()}
    first = bad.limit(1).first().external_transaction_id
    assert found == {("T1-00007", 1, True), (first, 2, False)}
    assert audit.label_duplicates(snap, "good").count() == 1
    assert [r.customer_id for r in audit.label_orphans(snap, "bad").collect()] == ["k1"]


def test_empty_store_and_empty_label(spark, tmp_dir):
    snap = store.snapshot(spark, tmp_dir + "/none")
    assert snap.read("transactions").count() == 0 and summaries.stats_total(snap).first()[0] == 0
    store.load_label(history(spark, 5).where("false"), people(spark).where("false"), tmp_dir, "e")
    assert store.compact(spark, tmp_dir) and store.compact(spark, tmp_dir) is None
    snap = store.snapshot(spark, tmp_dir)
    assert snap.read("transactions").count() == 0 and summaries.stats_by_currency(snap).count() == 0


def test_hot_id_is_split_in_joins_back(spark):
    """One id on half the rows: the join back is between two plain shuffles, which AQE can split."""
    rows = spark.range(2000).select(F.col("id").alias("row_key"), F.when(F.col("id") % 2 == 0, "hot")
                                    .otherwise(F.col("id").cast("string")).alias("transactionId"))
    held = spark.createDataFrame([("hot",), ("3",)], "external_transaction_id string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flags = dedupe.exists_flags(rows, held)
        marked = dedupe.mark_duplicates(rows, None)
        # rows and per-id table each have an exchange right below the join, besides those the aggregates need
        for df, exchanges in ((flags, 3), (marked, 3)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(transactionId") == exchanges
        assert flags.where("exists").count() == 1001
        assert marked.where("dup_code is null").count() == 1001
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_wide_batch_moves_each_id_once(spark, ledger, monkeypatch):
    root, want = ledger
    snap = store.snapshot(spark, root)
    ask = want.select("external_transaction_id").unionByName(
        spark.createDataFrame([(f"N{i}",) for i in range(300)] + [(None,)], "external_transaction_id string"))
    monkeypatch.setattr(id_index, "WIDE", 1)
    for skip, seeds in ((None, (0, 1, 2)), ("h1", (0, 2))):
        got = id_index.stored_ids(ask.unionByName(ask), "external_transaction_id", snap, exclude_batch=skip)
        assert not any("id_filters" in f or "candidates" in f for f in got.inputFiles())
        held = [r.external_transaction_id for r in want.collect()]
        assert sorted(r[0] for r in got.collect()) == sorted(x for x in held if int(x[1]) in seeds)
    one = spark.createDataFrame([("T2-00005",)], "external_transaction_id string")
    few = id_index.stored_ids(one, "external_transaction_id", snap)      # the store is larger than one id's tests
    assert few.count() == 1 and any("candidates" in f for f in few.inputFiles())


def test_run_tables_move_rows_once(spark, tmp_dir):
    """Summaries have one exchange; the index's files and their ranges hold every row."""
    rows = history(spark, 300, 7)
    plan = summaries.partial_summaries(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    store.load_label(rows, people(spark), tmp_dir, "a")
    snap = store.snapshot(spark, tmp_dir)
    found = {r.table: r for r in snap.read("files").where("table <> 'transactions'").collect()}
    assert found["ids"].file_rows == 300 and found["id_filters"].file_rows == snap.read("id_filters").count()
    assert len(found["ids"].first) == len(found["ids"].last) == 8 and found["ids"].first <= found["ids"].last


def test_only_valid_rows_are_joined(spark, tmp_dir, monkeypatch):
    """Invalid rows go to the rejects past the joins; texts of date and amount are not carried."""
    seen, real = [], ingest.classify_batch

    def watched(validated, *args):
        seen.append((validated.columns, [r.transactionId for r in validated.select("transactionId").collect()]))
        return real(validated, *args)

    monkeypatch.setattr(ingest, "classify_batch", watched)
    rows = batch(spark, ("C1", "T1", "5"), ("C1", "T1", "6"), ("", "T2", "x"), ("C2", None, "1"), (None, "T3", "2"), ("C2", "T4", "0.5"))
    for label, accepted in (("a", 2), ("a", 2), ("b", 0)):
        out = run_ingest(rows, tmp_dir, label, AS_OF)
        assert out == {"total_rows": 6, "accepted": accepted, "rejected": 6 - accepted, "duplicate": 3 - accepted, "invalid": 3, "unresolved": 0}
    assert [sorted(ids) for _, ids in seen] == [["T1", "T1", "T4"]] * 3
    assert not {"transactionDate", "amount"} & set(seen[0][0])
    found = [(r.ingest_batch, r.transactionId, r.status, [e.code for e in r.errors]) for r in store.read_rejects(spark, tmp_dir).collect()]
    invalid = [("T2", "invalid", ["cust_empty", "amt_bad", "amt_pos", "amt_max"]), ("", "invalid", ["txn_empty"]), ("T3", "invalid", ["cust_empty"])]
    twice = [("a", "T1", "duplicate", ["dup_batch"]), *(("b", x, "duplicate", ["dup_stored"]) for x in ("T1", "T1", "T4"))]
    assert sorted(found) == sorted([(label, *r) for label in "ab" for r in invalid] + twice)
