"""Anomaly detection: z-score outliers per category, near-duplicate charges.

Z-scores use exact moments: per (statement, category) the count, the sum
of units (millionths) and the sum of their squares are integer sums (partial
aggregation, map-side), so mean and sample deviation do not depend on how
rows are spread over tasks.  The group statistics table has one row per
(statement, category); it joins back to the expenses with a plain join
that AQE broadcasts when its measured size is small, and otherwise a
sort-merge join with skew splitting.

Near-duplicates compare each expense with the previous one of the same
description, by time.  ``previous_row`` does this in day buckets so that
one hot description never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.money import UNITS, units
from ledgerlens.functions.windows import day_bucket, previous_row
from ledgerlens.schemas import DUPLICATE_DAYS, Z_MIN_GROUP, Z_THRESHOLD

KEY = "statement_id"
ANOMALY_COLUMNS = ["statement_id", "txn_id", "date", "description", "amount", "category", "reason", "method"]


def fixed2(x: F.Column) -> F.Column:
    """Python's ``f"{x:.2f}"``: exact-binary rounding, no group separator."""
    return F.regexp_replace(F.format_number(x, 2), ",", "")


def zscore_stats(expenses: DataFrame, min_group: int = Z_MIN_GROUP) -> DataFrame:
    """Per (statement, category): n, mean (dollars), std (dollars, ddof=1);
    groups under ``min_group`` rows or with zero deviation are dropped."""
    c = F.col("_c").cast("decimal(38,0)")
    stats = expenses.groupBy(KEY, "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(c).alias("s1"),
        F.sum(c * c).alias("s2"),
    )
    m2 = F.col("n").cast("decimal(38,0)") * F.col("s2") - F.col("s1") * F.col("s1")
    return (
        stats.filter(F.col("n") >= min_group)
        .withColumn("m2", m2)
        .filter(F.col("m2") > 0)
        .select(
            KEY,
            "category",
            "n",
            (F.col("s1").cast("double") / F.col("n").cast("double")).alias("mean_c"),
            F.sqrt(F.col("m2").cast("double") / (F.col("n") * (F.col("n") - 1)).cast("double")).alias("std_c"),
        )
    )


def _expenses(txns: DataFrame) -> DataFrame:
    return txns.filter(F.col("amount") < 0).withColumn("_c", -units("amount")).filter(F.col("_c").isNotNull())


def zscore_anomalies(txns: DataFrame, threshold: float = Z_THRESHOLD, min_group: int = Z_MIN_GROUP) -> DataFrame:
    """Expenses whose |amount| lies more than ``threshold`` sample standard
    deviations above their category mean (one-sided, strict)."""
    exp = _expenses(txns).filter(F.col("category").isNotNull())
    stats = zscore_stats(exp, min_group)
    z = (F.col("_c").cast("double") - F.col("mean_c")) / F.col("std_c")
    joined = exp.join(stats, [KEY, "category"], "inner").withColumn("z", z)
    flagged = joined.filter(F.col("z") > F.lit(float(threshold)))
    reason = F.concat(
        F.lit("Unusually large for "),
        F.col("category"),
        F.lit(" (z="),
        fixed2(F.col("z")),
        F.lit(", avg=$"),
        fixed2(F.col("mean_c") / F.lit(float(UNITS))),
        F.lit(")"),
    )
    return flagged.select(
        KEY, "txn_id", "date", "description", "amount", "category",
        reason.alias("reason"), F.lit("z_score").alias("method"),
    )


def duplicate_charges(txns: DataFrame, max_days: int = DUPLICATE_DAYS) -> DataFrame:
    """An expense with the same amount as the previous expense of the same
    description (by time) at most ``max_days`` whole elapsed days before.
    Unparsed dates never flag; null descriptions drop out."""
    exp = txns.filter(
        (F.col("amount") < 0) & F.col("description").isNotNull() & F.col("ts").isNotNull()
    )
    prev = previous_row(
        exp,
        keys=[KEY, "description"],
        bucket=day_bucket("ts"),
        order=[F.col("ts"), F.col("txn_id"), F.col("amount")],
        columns=["ts", "amount"],
    )
    days = F.abs(F.timestamp_diff("DAY", F.col("prev_ts"), F.col("ts")))
    flagged = prev.filter(
        F.col("prev_ts").isNotNull() & (days <= max_days) & (F.col("amount") == F.col("prev_amount"))
    )
    reason = F.concat(
        F.lit("Possible duplicate — same amount charged "), days.cast("string"), F.lit(" day(s) apart")
    )
    return flagged.select(
        KEY, "txn_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), "description", "amount",
        F.coalesce(F.col("category"), F.lit("Other")).alias("category"),
        reason.alias("reason"), F.lit("duplicate").alias("method"),
    )


def anomalies(txns: DataFrame, threshold: float = Z_THRESHOLD) -> DataFrame:
    """Z-score hits and duplicates together; one transaction may be in both."""
    return zscore_anomalies(txns, threshold).unionByName(duplicate_charges(txns))


def mark_anomalies(txns: DataFrame, found: DataFrame) -> DataFrame:
    """Every expense, marked when its description is among the flagged
    descriptions of its statement (not only the flagged row)."""
    exp = txns.filter(F.col("amount") < 0)
    flagged = found.select(KEY, "description").distinct().withColumn("is_anomaly", F.lit(True))
    return exp.join(flagged, [KEY, "description"], "left").withColumn(
        "is_anomaly", F.coalesce("is_anomaly", F.lit(False))
    )


def flagged_points(txns: DataFrame, found: DataFrame) -> DataFrame:
    exp = txns.filter(F.col("amount") < 0)
    return exp.join(found.select(KEY, "description"), [KEY, "description"], "left_semi")


def normal_points(txns: DataFrame, found: DataFrame) -> DataFrame:
    exp = txns.filter(F.col("amount") < 0)
    return exp.join(found.select(KEY, "description"), [KEY, "description"], "left_anti")
