"""Streaming ingest with first-wins dedup and daily cash flow.

``readStream`` -> transaction columns -> ``foreachBatch``.  A watermark
would drop rows that arrive late, so none is used: every micro-batch is
compared with the keys stored for its own days, rows of new keys are
stored (in folders by month), and their sums per (statement, day) are
appended as one delta table per batch.  The current value of a day is the
sum of its deltas.  Late rows count like any others, the work of a batch
follows the days it touches, and no state grows in memory.

A batch writes only to folders that carry its own id and overwrites them,
and it reads only batches before it, so a batch that is run again after a
failure gives the same result (exactly once).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.money import dollars, units
from ledgerlens.sources.loader import scratch_path

DEDUP_KEY = ["statement_id", "date", "description", "amount"]
_ROWS = "statement_id long, date string, description string, amount double, day date, month string, batch long"
_DELTAS = "statement_id long, day date, income_units long, expenses_units long, n_txns long, batch long"


def month_of(day: Column) -> Column:
    """Name of the folder of a day; a row without a date has its own."""
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("none"))


def _stored(spark: SparkSession, folder: str, schema: str, before: int) -> DataFrame:
    """The rows that earlier batches wrote."""
    try:
        return spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/batch=*").where(F.col("batch") < before)
    except Exception as e:  # no batch has written yet
        if getattr(e, "getCondition", lambda: "")() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


WRITERS = 8  # tasks that write a month of one batch


def write_by_month(rows: DataFrame, path: str) -> None:
    """Write in folders by month; a batch inside one month has several writers."""
    part = F.pmod(F.xxhash64("statement_id", "description"), F.lit(WRITERS))
    rows.repartition("month", part).write.mode("overwrite").partitionBy("month").parquet(path)


def in_months(stored: DataFrame, days: DataFrame) -> DataFrame:
    """The stored rows in the months of ``days``.  The months of one batch's
    days (one value per calendar month) come to the driver, so that the scan
    lists only their folders."""
    months = days.select(month_of(F.col("day")).alias("month")).distinct().collect()
    return stored.filter(F.col("month").isin([r["month"] for r in months]))


def ingest_batch(batch: DataFrame, batch_id: int, out_dir: str) -> None:
    """Store the rows of new keys and the sums they add."""
    spark = batch.sparkSession
    day = F.to_date("ts")
    rows = batch.select(*DEDUP_KEY, day.alias("day"), month_of(day).alias("month")).dropDuplicates(DEDUP_KEY)
    stored = _stored(spark, f"{out_dir}/rows", _ROWS, batch_id)
    days = rows.select("day", "month").distinct()
    stored = in_months(stored, batch.select(day.alias("day")))
    near = stored.join(days, (stored["month"] == days["month"]) & stored["day"].eqNullSafe(days["day"]), "left_semi")
    same = [rows[c].eqNullSafe(near[c]) for c in DEDUP_KEY]
    fresh = rows.join(near, same, "left_anti")
    path = f"{out_dir}/rows/batch={batch_id}"
    write_by_month(fresh, path)
    written = spark.read.schema(_ROWS.replace(", batch long", "")).parquet(path)
    u = units("amount")
    written.groupBy("statement_id", "day").agg(
        F.coalesce(F.sum(F.when(u > 0, u)), F.lit(0)).alias("income_units"),
        F.coalesce(F.sum(F.when(u < 0, -u)), F.lit(0)).alias("expenses_units"),
        F.count(F.lit(1)).alias("n_txns"),
    ).write.mode("overwrite").parquet(f"{out_dir}/deltas/batch={batch_id}")


def run_daily_cashflow(
    spark: SparkSession,
    source: Callable[[SparkSession], DataFrame],
    out_dir: str | None = None,
) -> DataFrame:
    """Run T1 over everything available now and return the current daily
    rows (statement_id, day, income, expenses, n_txns) as a batch frame."""
    out_dir = out_dir or scratch_path(spark, "daily-cashflow")
    q = (
        source(spark).writeStream
        .foreachBatch(lambda batch, batch_id: ingest_batch(batch, batch_id, out_dir))
        .option("checkpointLocation", out_dir + "/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    deltas = _stored(spark, f"{out_dir}/deltas", _DELTAS, 1 << 62)
    now = deltas.groupBy("statement_id", "day").agg(
        *[F.sum(c).alias(c) for c in ("income_units", "expenses_units", "n_txns")])
    return now.select(
        "statement_id",
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        dollars("income_units").alias("income"),
        dollars("expenses_units").alias("expenses"),
        "n_txns",
    )
