"""File sources: CSV by header, JSON records, admission, row numbers, unnest."""

import os

from ledgerlake.sources import csv_split, files
from ledgerlake.sources.inline import chunked_parallel_arrays, unnest_parallel_arrays


def write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


def test_csv_by_header(spark, tmp_dir):
    d = f"{tmp_dir}/in"
    write(f"{d}/a.csv", "customerId,transactionId,transactionDate,amount,currency,sourceChannel\n"
          "C1,T1,2024-01-01,1.5,USD,web\n\nC2,T2,2024-01-02,\"1,234.5\",EUR,pos\n")
    write(f"{d}/b.csv", "sourceChannel,currency,amount,extra,transactionId,customerId\n"
          "api,GBP,3,zzz,T3,\"C,3\"\n"
          "web,USD,4,,\"T\"\"4\",\"C\n4\"\n"
          "pos,USD\n")
    write(f"{d}/c.csv", "customerId,transactionId\n")
    write(f"{d}/empty.csv", "")
    got = {r.transactionId: r for r in files.read_csv_by_header(spark, d).collect()}
    assert got["T1"].row_number == 1 and got["T2"].row_number == 2   # blank line skipped
    assert got["T2"].amount == "1,234.5"
    assert got["T3"].customerId == "C,3" and got["T3"].transactionDate == ""
    assert got['T"4'].customerId == "C\n4" and got['T"4'].row_number == 2
    short = [r for r in got.values() if r.sourceChannel == "pos" and r.currency == "USD"]
    assert short and short[0].transactionId == "" and short[0].row_number == 3
    assert len(got) == 5
    keys = sorted((r.source_file.endswith("a.csv"), r.row_key) for r in got.values())
    assert len({k for _, k in keys}) == 5


def test_row_numbers_over_split_blocks(spark, tmp_dir):
    d = f"{tmp_dir}/big"
    lines = ["customerId,transactionId"] + [f"C,T{i}" for i in range(1, 40001)]
    write(f"{d}/x.csv", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = files.read_csv_by_header(spark, d, multi_line=False)
        blocks = spark.read.csv(d).select("_metadata.file_block_start").distinct().count()
        assert blocks > 1
        bad = df.filter("concat('T', row_number) != transactionId").count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert bad == 0


def test_json_records(spark, tmp_dir):
    d = f"{tmp_dir}/j"
    write(f"{d}/a.json", '{"customerId":"C1","transactionId":"T1","transactionDate":'
          '"2024-01-01T00:00:00Z","amount":1e3,"currency":"USD","sourceChannel":"web","x":1}\n'
          '{not json\n'
          '{"customerId":"C2","transactionId":"T2","amount":"12.5"}\n'
          '{"customerId":"C3","transactionId":"T3","transactionDate":"yesterday","amount":2}\n')
    rows = {r.row_number: r for r in files.read_json_records(spark, d).collect()}
    assert rows[1].txn_amount == 1000 and rows[1]._corrupt_record is None
    assert rows[2]._corrupt_record is not None
    assert rows[3].txn_date is None
    assert rows[3].txn_amount == 12.5      # a quoted number is read as a number
    assert rows[4]._corrupt_record is not None       # date outside the ISO grammar


def test_admit_files(spark, tmp_dir):
    d = f"{tmp_dir}/adm"
    write(f"{d}/ok.CSV", "a\n1\n")
    write(f"{d}/empty.csv", "")
    write(f"{d}/notes.txt", "x\n")
    write(f"{d}/_SUCCESS", "")
    write(f"{d}/sub/.hidden.csv", "x\n")
    got = {os.path.basename(r.path): (r.admitted, r.reason)
           for r in files.admit_files(spark, d, max_bytes=3).collect()}
    assert got == {"ok.CSV": (False, "too_large"), "notes.txt": (False, "not_csv"), "empty.csv": (False, "empty")}
    ok = files.admit_files(spark, d).filter("admitted").collect()
    assert [os.path.basename(r.path) for r in ok] == ["ok.CSV"]
    # paths are as Spark's own sources write them, so they can be joined with a stream's
    read = spark.read.text(d).select("_metadata.file_path").distinct().collect()
    listed = {r.path for r in files.admit_files(spark, ["file:" + d, f"{d}/nowhere"]).collect()}
    assert {r.file_path.replace("file:///", "file:/") for r in read} <= listed
    assert files.admit_files(spark, []).count() == 0


def test_unnest_parallel_arrays(spark):
    df = spark.range(1234).selectExpr("id", "concat('C', id) AS ext").coalesce(1)
    chunks = chunked_parallel_arrays(df, ("id", "ext"), chunk_rows=500)
    assert chunks.count() == 3
    assert max(len(r.id) for r in chunks.collect()) == 500
    spread = chunked_parallel_arrays(df.repartition(4), ("id", "ext"), chunk_rows=100)
    assert max(len(r.id) for r in spread.collect()) <= 100
    back = unnest_parallel_arrays(chunks, ("id", "ext"))
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_csv_header_wider_than_read_width_fails(spark, tmp_dir):
    import pytest
    d = f"{tmp_dir}/wide"
    write(f"{d}/w.csv", ",".join(f"x{i}" for i in range(10)) + ",customerId\n" +
          ",".join("v" for _ in range(11)) + "\n")
    with pytest.raises(Exception, match="CSV header has 8 or more columns"):
        files.read_csv_by_header(spark, d, width=8).collect()
    ok = files.read_csv_by_header(spark, d, width=16).collect()
    assert ok[0].customerId == "v"


BREAKS = ['plain', '"a\nb"', '"x ""y""\n\n, z"', '"cr\r\nlf"', '""', '"comma, here"', '" \n"']


def broken_csv(rows, end="\n"):
    lines = ["note,transactionId,customerId"]
    lines += [f"{BREAKS[i % len(BREAKS)]},T{i},\"C\n{'z' * (i % 50)}{i}\"" for i in range(1, rows + 1)]
    return end.join(lines) + end


def test_csv_blocks_equal_the_one_task_reader(spark, tmp_dir):
    d = f"{tmp_dir}/split"
    write(f"{d}/a.csv", broken_csv(3000), "w")
    with open(f"{d}/b.csv", "w", newline="") as f:
        f.write(broken_csv(500, "\r\n").replace("T7,", "T7,,,") + "\r\n\r\nlast,Tlast,\"end\"")
    write(f"{d}/c.csv", "customerId,transactionId\n")
    write(f"{d}/empty.csv", "")
    wanted = ("customerId", "transactionId", "note", "missing")

    def rows(df):                                      # the one-task reader turns CR LF in a field into LF
        return sorted(tuple(v.replace("\r\n", "\n") if isinstance(v, str) else v for v in r) for r in df.collect())

    whole = rows(files.read_csv_by_header(spark, d, wanted))
    assert len(whole) == 3501
    split = csv_split.read_csv_split(spark, d, wanted)
    assert rows(split) == whole
    assert split.filter("endswith(source_file, 'b.csv') and contains(note, '\r\n')").count() > 0
    for size in ("997", "20000"):                      # breaks, and CR LF pairs, across many block borders
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            blocks = spark.read.text(f"{d}/a.csv").select("_metadata.file_block_start").distinct().count()
            assert blocks > 3
            assert rows(csv_split.read_csv_split(spark, d, wanted, width=8)) == whole
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_blocks_share_one_exchange(spark, tmp_dir):
    d = f"{tmp_dir}/plan"
    write(f"{d}/a.csv", broken_csv(300))
    df = csv_split.read_csv_split(spark, d, width=5)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan text") == 1 and "ReusedExchange" in plan


def test_csv_blocks_refuse_what_would_swallow_a_file(spark, tmp_dir):
    import pytest
    for name, text, message in (
            ("open", 'customerId,transactionId\nC1,"T1\nC2,T2\n', "never closed"),
            ("head", 'customerId,"trans\nactionId"\nC1,T1\n', "header over several lines"),
            ("wide", "a,b,c,d,e,f,customerId\n1,2,3,4,5,6,7\n", "5 or more columns")):
        write(f"{tmp_dir}/{name}/x.csv", text)
        with pytest.raises(Exception, match=message):
            csv_split.read_csv_split(spark, f"{tmp_dir}/{name}", width=5).collect()
