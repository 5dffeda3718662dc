"""T1 and T2 across micro-batches, with rows in any order of arrival."""

import datetime as dt

from conftest import txn_frame

from ledgerlens.sources.loader import scratch_path
from ledgerlens.streaming.duplicates import judge_batch, run_duplicate_stream
from ledgerlens.streaming.ingest import run_daily_cashflow

SCHEMA = "statement_id long, txn_id long, ts timestamp_ntz, description string, amount double, category string"


def test_late_rows_count_and_verdicts_change(spark):
    src, out = scratch_path(spark, "t2-src"), scratch_path(spark, "t2-out")
    d = dt.datetime(2024, 3, 1, 9, 0)
    day = lambda n: d + dt.timedelta(days=n)

    def source(s):
        return s.readStream.schema(SCHEMA).parquet(src + "/part=*")

    def step(n, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{src}/part={n}")
        return sorted((r["txn_id"], r["reason"][-16:]) for r in run_duplicate_stream(spark, source, out).collect())

    assert [t for t, _ in step(1, [(1, 10, day(20), "GYM", -30.0, "H"), (1, 11, day(22), "GYM", -30.0, "H")])] == [11]
    # A month-old row still pairs with its neighbours.
    late = step(2, [(1, 1, day(-30), "GYM", -30.0, "H"), (1, 2, day(-29), "GYM", -30.0, "H")])
    assert [t for t, _ in late] == [2, 11]
    # A late charge of another amount between the two withdraws the first verdict.
    assert [t for t, _ in step(3, [(1, 12, day(21), "GYM", -9.0, "H")])] == [2]
    # A late equal charge makes a new one.
    assert [t for t, _ in step(4, [(1, 13, day(19), "GYM", -30.0, "H")])] == [2, 10]


def test_cashflow_counts_late_rows_and_repeats_once(spark):
    src, out = scratch_path(spark, "t1-src"), scratch_path(spark, "t1-out")
    schema = "statement_id long, txn_id long, ts timestamp_ntz, date string, description string, amount double"
    row = lambda i, day, amount: (1, i, dt.datetime(2024, 3, day), f"2024-03-{day:02d}", "A", amount)

    def step(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/part={n}")
        got = run_daily_cashflow(spark, lambda s: s.readStream.schema(schema).parquet(src + "/part=*"), out)
        return sorted((r.day, r.income, r.expenses, r.n_txns) for r in got.collect())

    assert step(1, [row(1, 20, 5.0), row(2, 20, 5.0), row(3, 20, -1.5)]) == [("2024-03-20", 5.0, 1.5, 2)]
    assert step(2, [row(4, 1, -2.0), row(5, 20, 5.0)]) == [("2024-03-01", 0.0, 2.0, 1), ("2024-03-20", 5.0, 1.5, 2)]


def test_duplicate_found_across_batches(spark):
    src = scratch_path(spark, "t2-src")
    out = scratch_path(spark, "t2-out")
    d = dt.datetime(2024, 3, 1, 9, 0)
    first = [
        (1, 1, d, "GYM", -30.0, "Health"),
        (1, 2, d + dt.timedelta(days=10), "GYM", -30.0, "Health"),  # 10 days: no flag
        (2, 3, d, "GYM", -30.0, "Health"),
    ]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(src + "/part=1")

    def source(s):
        return s.readStream.schema(SCHEMA).parquet(src + "/part=*")

    got = run_duplicate_stream(spark, source, out)
    assert got.count() == 0
    # Second batch: its only row of statement 1 repeats txn 2 two days later.
    second = [
        (1, 4, d + dt.timedelta(days=12), "GYM", -30.0, "Health"),
        (2, 5, d + dt.timedelta(days=40), "GYM", -30.0, "Health"),
    ]
    spark.createDataFrame(second, SCHEMA).coalesce(1).write.parquet(src + "/part=2")
    got = run_duplicate_stream(spark, source, out)
    rows = [(r["statement_id"], r["txn_id"], r["date"], r["reason"]) for r in got.collect()]
    assert rows == [(1, 4, "2024-03-13", "Possible duplicate — same amount charged 2 day(s) apart")]


def test_a_batch_lists_only_the_months_it_touches(spark):
    from ledgerlens.streaming.ingest import in_months, write_by_month

    path = scratch_path(spark, "months")
    d = dt.date(2024, 1, 30)
    rows = spark.createDataFrame(
        [(1, "A", d + dt.timedelta(days=20 * i), (d + dt.timedelta(days=20 * i)).strftime("%Y-%m")) for i in range(9)],
        "statement_id long, description string, day date, month string")
    write_by_month(rows, path)
    stored = spark.read.schema(rows.schema).parquet(path)
    near = in_months(stored, rows.filter("day < date'2024-03-01'").select("day"))
    assert sorted({r["month"] for r in near.collect()}) == ["2024-01", "2024-02"]
    plan = near._jdf.queryExecution().toString()
    assert "PartitionFilters: [month" in plan and "PartitionFilters: []" not in plan


def test_a_batch_stores_only_its_own_days(spark):
    """The days that a batch can change are not written out one by one."""
    out = scratch_path(spark, "duplicate-stream")
    day = dt.datetime(2024, 1, 30)
    first = [(1, 1, day, "RENT", -5.0, "a"), (None, 2, day, "RENT", -5.0, "a"), (1, 3, day, "RENT", -5.0, "a")]
    late = [(1, 4, day + dt.timedelta(days=3), "RENT", -5.0, "a"), (1, 5, day + dt.timedelta(days=9), "RENT", -5.0, "a")]
    for i, rows in enumerate((first, late)):
        judge_batch(txn_frame(spark, rows), i, out)
    assert spark.read.parquet(f"{out}/pairs/batch=0").count() == 2 and spark.read.parquet(f"{out}/pairs/batch=1").count() == 2
    assert [r["txn_id"] for r in spark.read.parquet(f"{out}/found/batch=1").collect()] == [4]
