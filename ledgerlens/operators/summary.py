"""Per-statement financial summary (six metrics, by category, by month).

The reference runs eight SQL scans for one statement; here the six
scalar metrics are one conditional aggregation per ``statement_id`` (one
scan, partial aggregation before the shuffle), and the two breakdowns are
one aggregation each.  The combined record (A10) is a single
grouping-sets aggregation over (statement), (statement, category) and
(statement, month): one scan, one partial aggregate, then one small
aggregation per statement; no joins.  Money is summed
as integer millionths (exact, the same on any partitioning); the six
metrics are rounded to cents once, after the sum, the breakdowns not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.money import dollars, rounded, rounded_mean, units

KEY = "statement_id"


def _month(txns: DataFrame) -> F.Column:
    # Unparsed dates (null ts) form one null month, as in SQLite's strftime.
    return F.date_format("ts", "yyyy-MM")


def _metrics(txns: DataFrame, keys: list[str]) -> DataFrame:
    amount = F.col("amount")
    c = units(amount)
    agg = txns.groupBy(*keys).agg(
        F.sum(F.when(amount > 0, c)).alias("_inc"),
        F.sum(F.when(amount < 0, -c)).alias("_exp"),
        F.sum(c).alias("_net"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.count(F.when(amount < 0, F.lit(1))).alias("_n_exp"),
        F.max(F.when(amount < 0, -c)).alias("_max"),
    )
    return agg.select(
        *keys,
        rounded(F.coalesce("_inc", F.lit(0))).alias("total_income"),
        rounded(F.coalesce("_exp", F.lit(0))).alias("total_expenses"),
        rounded(F.coalesce("_net", F.lit(0))).alias("net_cashflow"),
        F.col("transaction_count"),
        F.coalesce(rounded_mean(F.col("_exp"), F.col("_n_exp")), F.lit(0.0)).alias("avg_expense"),
        rounded(F.coalesce("_max", F.lit(0))).alias("largest_expense"),
    )


def financial_summary(txns: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """total_income, total_expenses, net_cashflow, transaction_count,
    avg_expense (rounded to cents, half up), largest_expense per statement."""
    return _metrics(txns, keys or [KEY])


def metric(txns: DataFrame, name: str) -> DataFrame:
    """One of the six metrics alone."""
    return financial_summary(txns).select(KEY, name)


def spending_by_category(txns: DataFrame) -> DataFrame:
    """Expense total and count per category, with its rank (total desc,
    category as tie-break).  Null categories form their own group, as in SQL."""
    c = units("amount")
    agg = (
        txns.filter(F.col("amount") < 0)
        .groupBy(KEY, "category")
        .agg(F.sum(-c).alias("total_units"), F.count(F.lit(1)).alias("count"))
    )
    # The rank window runs over the aggregated rows (categories per statement).
    w = Window.partitionBy(KEY).orderBy(F.desc("total_units"), F.asc_nulls_first("category"))
    return agg.select(
        KEY,
        "category",
        dollars("total_units").alias("total"),
        "count",
        F.row_number().over(w).cast("bigint").alias("rank"),
        "total_units",
    )


def monthly_breakdown(txns: DataFrame) -> DataFrame:
    """Income and expenses per month; zero amounts count on neither side."""
    amount = F.col("amount")
    c = units(amount)
    agg = txns.groupBy(F.col(KEY), _month(txns).alias("month")).agg(
        F.sum(F.when(amount > 0, c).otherwise(0)).alias("income_units"),
        F.sum(F.when(amount < 0, -c).otherwise(0)).alias("expenses_units"),
    )
    return agg.select(
        KEY,
        "month",
        dollars("income_units").alias("income"),
        dollars("expenses_units").alias("expenses"),
        "income_units",
        "expenses_units",
    )


def summary_record(txns: DataFrame) -> DataFrame:
    """A10: one row per statement, the six metrics plus the two breakdowns as
    ordered ``array<struct>`` columns (category by rank, month ascending,
    null month first)."""
    amount = F.col("amount")
    c = units(amount)
    with_month = txns.withColumn("month", _month(txns))
    # grouping_id: 0 = (statement, category, month) never occurs; the
    # levels used are 3 = statement, 1 = statement + category,
    # 2 = statement + month (a bit is set for each column left out).
    fine = with_month.groupingSets([[KEY], [KEY, "category"], [KEY, "month"]], KEY, "category", "month").agg(
        F.grouping_id().alias("gid"),
        F.sum(F.when(amount > 0, c)).alias("inc"),
        F.sum(F.when(amount < 0, -c)).alias("exp"),
        F.sum(c).alias("net"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(amount < 0, F.lit(1))).alias("n_exp"),
        F.max(F.when(amount < 0, -c)).alias("max_exp"),
    )
    at = lambda level, col: F.when(F.col("gid") == level, col)
    per_statement = fine.groupBy(KEY).agg(
        F.max(at(3, F.col("inc"))).alias("_inc"),
        F.max(at(3, F.col("exp"))).alias("_exp"),
        F.max(at(3, F.col("net"))).alias("_net"),
        F.max(at(3, F.col("n"))).alias("transaction_count"),
        F.max(at(3, F.col("n_exp"))).alias("_n_exp"),
        F.max(at(3, F.col("max_exp"))).alias("_max"),
        # Categories with expenses, by total desc then category (nulls first).
        F.sort_array(F.collect_list(F.when(
            (F.col("gid") == 1) & (F.col("n_exp") > 0),
            F.struct((-F.col("exp")).alias("k"), F.col("category"), dollars("exp").alias("total"), F.col("n_exp").alias("count")),
        ))).alias("_cats"),
        F.sort_array(F.collect_list(at(2, F.struct(
            F.col("month"),
            dollars(F.coalesce("inc", F.lit(0))).alias("income"),
            dollars(F.coalesce("exp", F.lit(0))).alias("expenses"),
        )))).alias("monthly_breakdown"),
    )
    return per_statement.select(
        KEY,
        rounded(F.coalesce("_inc", F.lit(0))).alias("total_income"),
        rounded(F.coalesce("_exp", F.lit(0))).alias("total_expenses"),
        rounded(F.coalesce("_net", F.lit(0))).alias("net_cashflow"),
        F.col("transaction_count"),
        F.coalesce(rounded_mean(F.col("_exp"), F.col("_n_exp")), F.lit(0.0)).alias("avg_expense"),
        rounded(F.coalesce("_max", F.lit(0))).alias("largest_expense"),
        F.transform(
            "_cats",
            lambda x: F.struct(x["category"].alias("category"), x["total"].alias("total"), x["count"].alias("count")),
        ).alias("spending_by_category"),
        "monthly_breakdown",
    )


def flatten_summary(record: DataFrame) -> DataFrame:
    """Scalar view of ``summary_record``: sizes and the key order of the
    two breakdowns as text."""
    return record.select(
        KEY,
        "total_income",
        "total_expenses",
        "net_cashflow",
        "transaction_count",
        "avg_expense",
        "largest_expense",
        F.size("spending_by_category").cast("bigint").alias("n_categories"),
        F.size("monthly_breakdown").cast("bigint").alias("n_months"),
        F.array_join(F.transform("spending_by_category", lambda s: s["category"]), ",", "NULL").alias("category_order"),
        F.array_join(F.transform("monthly_breakdown", lambda s: s["month"]), ",", "NULL").alias("month_order"),
    )


def category_share(txns: DataFrame) -> DataFrame:
    """Share of each category in the statement's expenses."""
    sbc = spending_by_category(txns)
    w = Window.partitionBy(KEY)
    return sbc.select(
        KEY,
        "category",
        "total",
        (F.col("total_units").cast("double") / F.sum("total_units").over(w).cast("double")).alias("share"),
    )


def cashflow_series(txns: DataFrame) -> DataFrame:
    """U8: monthly income and expenses melted to (month, series, value)."""
    mb = monthly_breakdown(txns).select(KEY, "month", "income", "expenses")
    return mb.unpivot([KEY, "month"], ["income", "expenses"], "series", "value")
