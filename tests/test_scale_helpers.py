"""Partitioning and lineage helpers: same results, intended plans."""

import datetime as dt
import random

from conftest import SF_SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions.windows import day_bucket, previous_row, running_totals
from ledgerlens.session import cut_lineage
from ledgerlens.sources.tables import read_table, spread


def _keyed(spark, n=2000, seed=11):
    """Two key columns, some of them null; a hot key; days spread over two months."""
    rnd = random.Random(seed)
    d0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        k1 = None if rnd.random() < 0.1 else (0 if rnd.random() < 0.4 else rnd.randint(1, 5))
        k2 = None if rnd.random() < 0.1 else rnd.choice(["a", "b", ""])
        ts = d0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 60))
        rows.append((k1, k2, i, ts, rnd.randint(-100, 100)))
    return spark.createDataFrame(rows, "k1 long, k2 string, id long, ts timestamp_ntz, v long")


def test_null_keys_are_their_own_groups(spark):
    df = _keyed(spark)
    order = [F.col("ts"), F.col("id")]
    w = Window.partitionBy("k1", "k2").orderBy("ts", "id")
    got = running_totals(df, ["k1", "k2"], day_bucket("ts"), order, {"s": F.col("v")})
    want = df.select("id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    assert sorted(got.select("id", "s").collect()) == sorted(want.collect())
    got = previous_row(df, ["k1", "k2"], day_bucket("ts"), order, ["id"])
    want = df.select("id", F.lag("id").over(w).alias("prev_id"))
    assert sorted(got.select("id", "prev_id").collect()) == sorted(want.collect())
    assert got.count() == df.count()


def test_join_back_keeps_window_partitioning(spark):
    """The rows are shuffled once (for the window); the join back must not
    shuffle them again on rewritten (null-safe) keys."""
    df = _keyed(spark)
    out = previous_row(df, ["k1"], day_bucket("ts"), [F.col("ts"), F.col("id")], ["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("coalesce(" in line for line in exchanges)
    # One exchange for the rows (window); partial aggregate, bucket window
    # and join side move the small bucket table.
    assert len(exchanges) == 4


def test_spread_only_small_scans(spark):
    docs = read_table(spark, SF_SMALL, "documents", "doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    spread_docs = spread(docs, "doc_id")
    if docs.rdd.getNumPartitions() < cores:
        assert spread_docs.rdd.getNumPartitions() == cores
    else:
        assert spread_docs is docs
    assert sorted(spread_docs.select("doc_id").collect()) == sorted(docs.select("doc_id").collect())


def test_cut_lineage_same_rows_short_plan(spark):
    df = _keyed(spark).groupBy("k1").agg(F.sum("v").alias("s"))
    cut = cut_lineage(df)
    key = lambda r: (r["k1"] is None, r["k1"] or 0)
    assert sorted(cut.collect(), key=key) == sorted(df.collect(), key=key)
    assert "Aggregate" not in cut._jdf.queryExecution().optimizedPlan().toString()


def test_summary_record_is_one_scan_without_joins(spark):
    from ledgerlens.operators import summary as A

    t = read_table(spark, SF_SMALL, "events", "event_id", "user_id", "value", "event_type", "ts").select(
        F.col("user_id").alias("statement_id"), F.col("event_id").alias("txn_id"), "ts",
        (-F.col("value")).alias("amount"), F.col("event_type").alias("category"),
    )
    plan = A.summary_record(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "Join" not in plan
