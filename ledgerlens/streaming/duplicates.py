"""Near-duplicate charges in a stream, for rows in any order of arrival.

A row that arrives late becomes the neighbour of rows that were judged
before, so a batch judges again exactly the days it can change.  A charge
pairs with the previous one of its (statement, description) at most
``max_days`` days before: a new row on day ``d`` can change the verdicts of
its key on the days ``d .. d + max_days`` (later ones look back no further),
and these verdicts depend on rows from ``max_days`` days before.

Per micro-batch: the new expenses are stored (in folders by month) with their
(key, day) pairs; the stored rows of the spans of ``SPAN`` days that hold a day
which counts are compared with W2's rule; and the verdicts of touched days are
written with the batch id.  The verdicts of a day are those of the latest
batch that touched it, so a verdict can be withdrawn, nothing is dropped,
and the result always equals the batch W2 over all rows so far.  Which days a
batch touched is asked from the verdicts, which are few: a verdict looks for new
rows on its own day and ``max_days + 1`` days before.  A batch reads
only the month folders of the touched days; no key is one Python call, and no state is held.

A batch writes only to folders of its own id and overwrites them, so a
batch that runs again gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.anomalies import duplicate_charges
from ledgerlens.schemas import DUPLICATE_DAYS
from ledgerlens.sources.loader import scratch_path, written_frame
from ledgerlens.streaming.ingest import _stored, in_months, month_of, write_by_month

_ROWS = (
    "statement_id long, txn_id long, ts timestamp_ntz, description string, amount double, category string, "
    "day date, month string, batch long"
)
_PAIRS = "statement_id long, description string, day date, batch long"
OUT_SCHEMA = (
    "statement_id long, txn_id long, date string, description string, amount double, "
    "category string, reason string, method string, batch long"
)
_KEY = ["statement_id", "description"]
SPAN = 32  # days that are looked up together


def _touched(found: DataFrame, pairs: DataFrame, max_days: int) -> DataFrame:
    """(key, day of a verdict, columns of ``pairs``) for each pair with new rows
    that touches the verdict's day."""
    asked = found.select(*_KEY, F.to_date("date").alias("at")).distinct()
    # A gap of max_days whole days can span max_days + 1 dates.
    asked = asked.withColumn("near", F.explode(F.sequence(F.date_sub("at", max_days + 1), F.col("at"))))
    new = pairs.withColumnRenamed("statement_id", "new_id").withColumnRenamed("description", "new_description")
    return asked.join(new, [asked["statement_id"].eqNullSafe(new["new_id"]), asked["description"] == new["new_description"],
                            asked["near"] == new["day"]])


def _on_day(found: DataFrame, days: DataFrame) -> list:
    return [found["statement_id"].eqNullSafe(days["statement_id"]), found["description"] == days["description"],
            F.to_date(found["date"]) == days["at"]]


def judge_batch(batch: DataFrame, batch_id: int, out_dir: str, max_days: int = DUPLICATE_DAYS) -> None:
    spark = batch.sparkSession
    new = batch.filter((F.col("amount") < 0) & F.col("description").isNotNull() & F.col("ts").isNotNull()).select(
        "statement_id", "txn_id", "ts", "description", "amount", "category", F.to_date("ts").alias("day"),
        month_of(F.to_date("ts")).alias("month"))
    write_by_month(new, f"{out_dir}/rows/batch={batch_id}")
    rows = _stored(spark, f"{out_dir}/rows", _ROWS, batch_id + 1)
    days = rows.where(F.col("batch") == batch_id).select(*_KEY, "day").distinct()
    days.write.mode("overwrite").parquet(f"{out_dir}/pairs/batch={batch_id}")
    days = spark.read.schema(_PAIRS.replace(", batch long", "")).parquet(f"{out_dir}/pairs/batch={batch_id}")
    first, last = F.date_sub("day", max_days + 1), F.date_add("day", max_days + 1)
    span = lambda day: F.floor(F.unix_date(day) / F.lit(SPAN)).cast("int")
    around = days.select(*_KEY, F.explode(F.sequence(span(first), span(last))).alias("span")).distinct()
    rows = in_months(rows, days.select(F.explode(F.array(first, last)).alias("day"))).withColumn("span", span(F.col("day")))
    near = rows.join(around, [rows["statement_id"].eqNullSafe(around["statement_id"]),
                              rows["description"] == around["description"], rows["span"] == around["span"]], "left_semi")
    found = written_frame(duplicate_charges(near, max_days), "found")
    mine = _touched(found, days, max_days).select(*_KEY, "at").distinct()
    found.join(mine, _on_day(found, mine), "left_semi").write.mode("overwrite").parquet(f"{out_dir}/found/batch={batch_id}")


def run_duplicate_stream(
    spark: SparkSession, source: Callable[[SparkSession], DataFrame], out_dir: str | None = None
) -> DataFrame:
    """Run T2 over everything available now and return the verdicts that
    hold after the last batch."""
    out_dir = out_dir or scratch_path(spark, "duplicate-stream")
    q = (
        source(spark).writeStream
        .foreachBatch(lambda batch, batch_id: judge_batch(batch, batch_id, out_dir))
        .option("checkpointLocation", out_dir + "/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    found = _stored(spark, f"{out_dir}/found", OUT_SCHEMA, 1 << 62)
    pairs = _stored(spark, f"{out_dir}/pairs", _PAIRS, 1 << 62)
    latest = _touched(found, pairs, DUPLICATE_DAYS).groupBy(*_KEY, "at").agg(F.max("batch").alias("last"))
    return found.join(latest, [*_on_day(found, latest), found["batch"] == latest["last"]], "left_semi").drop("batch")
