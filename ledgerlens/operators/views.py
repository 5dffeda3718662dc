"""Interactive filters and list views over transactions.

All are projections/filters (pushed to the scan by Catalyst) or one
aggregation keyed by statement.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.money import money_text

KEY = "statement_id"
ALL = "All"


def category_choices(txns: DataFrame) -> DataFrame:
    """``All`` followed by the statement's categories in sorted order."""
    cats = txns.filter(F.col("category").isNotNull()).select(KEY, "category").distinct()
    # Window over distinct (statement, category) pairs only.
    ranked = cats.select(
        KEY,
        F.col("category").alias("choice"),
        F.row_number().over(Window.partitionBy(KEY).orderBy("category")).cast("bigint").alias("ord"),
    )
    alls = txns.select(KEY).distinct().select(KEY, F.lit(ALL).alias("choice"), F.lit(0).cast("bigint").alias("ord"))
    return alls.unionByName(ranked)


def filter_category(txns: DataFrame, value: str) -> DataFrame:
    """Exact category match; ``All`` means no filter."""
    return txns if value == ALL else txns.filter(F.col("category") == F.lit(value))


def filter_type(txns: DataFrame, value: str) -> DataFrame:
    """``debit`` / ``credit``; ``All`` means no filter."""
    return txns if value == ALL else txns.filter(F.col("type") == F.lit(value))


def description_predicate(term: str, literal: bool = False) -> F.Column:
    """U4: case-insensitive search in the description; the term is a regular
    expression unless ``literal``; a null description never matches."""
    pattern = re.escape(term) if literal else term
    return F.coalesce(F.col("description").rlike("(?iu)" + pattern), F.lit(False))


def search_description(txns: DataFrame, term: str, literal: bool = False) -> DataFrame:
    return txns if not term else txns.filter(description_predicate(term, literal))


def filter_counts(txns: DataFrame, category: str = ALL, type_: str = ALL, term: str = "") -> DataFrame:
    """Rows shown by the three filters and the total, per statement, in
    one aggregation."""
    pred = F.lit(True)
    if category != ALL:
        pred = pred & (F.col("category") == F.lit(category))
    if type_ != ALL:
        pred = pred & (F.col("type") == F.lit(type_))
    if term:
        pred = pred & description_predicate(term)
    return txns.groupBy(KEY).agg(
        F.count_if(F.coalesce(pred, F.lit(False))).alias("shown"),
        F.count(F.lit(1)).alias("total"),
    )


def format_currency(txns: DataFrame) -> DataFrame:
    """``$1,234.56`` texts of amount and balance."""
    return txns.select(
        KEY, "txn_id",
        money_text("amount").alias("amount_text"),
        money_text("balance").alias("balance_text"),
    )


def anomaly_view(found: DataFrame) -> DataFrame:
    """Expander title, method label and the count per statement."""
    title = F.concat(
        F.lit("⚠️ "), F.col("date"), F.lit(" | "), F.col("description"), F.lit(" | "),
        money_text(F.abs(F.col("amount"))),
    )
    counts = found.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_anomalies"))
    return found.select(
        KEY, "txn_id", "method",
        title.alias("title"),
        F.initcap(F.regexp_replace("method", "_", " ")).alias("method_label"),
    ).join(counts, KEY, "inner")
