"""Report text per statement (R1-R4): string aggregation of bounded groups.

Each text is built from already-aggregated rows (categories, months,
anomalies, top-k hits of one statement), never from all transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.money import money_text
from ledgerlens.operators.anomalies import fixed2

KEY = "statement_id"
NO_ANOMALIES = "No anomalies detected."
NO_RELEVANT = "No specific transactions retrieved."
BULLET = "  • "


def _lines(arr: Column) -> Column:
    return F.array_join(arr, "\n")


def summary_text(record: DataFrame) -> DataFrame:
    """R1 from ``summary.summary_record``: six metric lines, category and
    month bullets.  The count prints as ``11.0``: the reference rounds it
    through ``float`` before rendering."""
    cats = F.transform(
        "spending_by_category",
        lambda c: F.concat(
            F.lit(BULLET), F.coalesce(c["category"], F.lit("None")), F.lit(": "), money_text(c["total"]),
            F.lit(" ("), c["count"].cast("string"), F.lit(" transactions)"),
        ),
    )
    months = F.transform(
        "monthly_breakdown",
        lambda m: F.concat(
            F.lit(BULLET), F.coalesce(m["month"], F.lit("None")), F.lit(": Income "), money_text(m["income"]),
            F.lit(" | Expenses "), money_text(m["expenses"]),
        ),
    )
    head = F.array(
        F.concat(F.lit("- Total Income:      "), money_text("total_income")),
        F.concat(F.lit("- Total Expenses:    "), money_text("total_expenses")),
        F.concat(F.lit("- Net Cashflow:      "), money_text("net_cashflow")),
        F.concat(F.lit("- Transaction Count: "), F.col("transaction_count").cast("string"), F.lit(".0")),
        F.concat(F.lit("- Avg Expense:       "), money_text("avg_expense")),
        F.concat(F.lit("- Largest Expense:   "), money_text("largest_expense")),
        F.lit(""),
        F.lit("Spending by Category:"),
    )
    text = _lines(F.concat(head, cats, F.array(F.lit("\nMonthly Breakdown:")), F.coalesce(months, F.array().cast("array<string>"))))
    return record.select(KEY, text.alias("summary_text"))


def anomaly_text(statements: DataFrame, found: DataFrame) -> DataFrame:
    """R2: one bullet per anomaly (z-score hits first, by category, then
    duplicates by description and date), or the fixed no-anomaly line."""
    line = F.concat(
        F.lit(BULLET), F.lit("["), F.upper("method"), F.lit("] "), F.col("date"), F.lit(" | "), F.col("description"),
        F.lit(" | "), money_text(F.abs(F.col("amount"))), F.lit(" — "), F.col("reason"),
    )
    order = F.struct(
        F.when(F.col("method") == "z_score", 0).otherwise(1).alias("m"),
        F.when(F.col("method") == "z_score", F.col("category")).otherwise(F.col("description")).alias("g"),
        F.col("date").alias("d"),
        F.col("txn_id").alias("t"),
    )
    per = found.groupBy(KEY).agg(
        _lines(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda s: s["l"])).alias("t")
    )
    return statements.select(KEY).distinct().join(per, KEY, "left").select(
        KEY, F.coalesce("t", F.lit(NO_ANOMALIES)).alias("anomaly_text")
    )


def relevant_text(keys: DataFrame, hits: DataFrame, key: str = KEY) -> DataFrame:
    """One bullet per search hit in rank order, or the fixed line."""
    line = F.concat(
        F.lit(BULLET), F.coalesce(F.col("date"), F.lit("")), F.lit(" | "), F.coalesce(F.col("description"), F.lit("")),
        F.lit(" | "), money_text(F.abs(F.coalesce(F.col("amount"), F.lit(0.0)))), F.lit(" | "),
        F.coalesce(F.col("category"), F.lit("")), F.lit(" (score: "), fixed2(F.col("similarity_score")), F.lit(")"),
    )
    per = hits.groupBy(key).agg(
        _lines(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))), lambda s: s["l"])).alias("t")
    )
    return keys.select(key).distinct().join(per, key, "left").select(
        key, F.coalesce("t", F.lit(NO_RELEVANT)).alias("relevant_text")
    )


def advisor_context(summary: DataFrame, anomalies_: DataFrame, relevant: DataFrame | None, question: Column) -> DataFrame:
    """The advisor prompt body with its fixed headings (no history:
    the reference never puts it in the prompt).  ``relevant`` may be None
    (no search run): the fixed no-result line is used."""
    j = summary.join(anomalies_, KEY, "left")
    j = j.join(relevant, KEY, "left") if relevant is not None else j.withColumn("relevant_text", F.lit(None).cast("string"))
    text = F.concat(
        F.lit("FINANCIAL SUMMARY:\n"), F.col("summary_text"),
        F.lit("\n\nANOMALIES DETECTED:\n"), F.coalesce("anomaly_text", F.lit(NO_ANOMALIES)),
        F.lit("\n\nRELEVANT TRANSACTIONS (semantic search results):\n"), F.coalesce("relevant_text", F.lit(NO_RELEVANT)),
        F.lit("\n\nUSER QUESTION:\n"), question,
    )
    return j.select(KEY, text.alias("context"))
