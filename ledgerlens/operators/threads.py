"""Conversation history and run control as data (H1-H5).

A conversation is a set of rows ``(conv_id, turn, role, text)``.  Append,
latest state and question/answer pairing are aggregations or bucketed
neighbour look-ups; run status is a column, not an exception.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.windows import previous_row

NO_STATEMENT = "No statement loaded yet. Please upload a PDF first."


def history_append(history: DataFrame, new_turns: DataFrame) -> DataFrame:
    """H1: add new turns after the stored ones of each conversation; new
    turns are numbered after the last stored turn, in their own order."""
    last = history.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    w = Window.partitionBy("conv_id").orderBy("turn")  # over the new turns only
    added = (
        new_turns.join(last, "conv_id", "left")
        .withColumn("turn", F.coalesce("_last", F.lit(-1)) + F.row_number().over(w))
        .drop("_last")
    )
    return history.select("conv_id", "turn", "role", "text").unionByName(added.select("conv_id", "turn", "role", "text"))


def latest_turn(history: DataFrame) -> DataFrame:
    """H2: the last turn of each conversation (aggregated map-side)."""
    return history.groupBy("conv_id").agg(
        F.max_by(F.struct("turn", "role", "text"), "turn").alias("s")
    ).select("conv_id", "s.turn", "s.role", "s.text")


def qa_pairs(history: DataFrame, bucket_turns: int = 1024) -> DataFrame:
    """H3: each assistant turn that directly follows a user turn, with that
    question; neighbour look-up in turn buckets (no whole conversation in
    one task)."""
    prev = previous_row(
        history,
        keys=["conv_id"],
        bucket=F.floor(F.col("turn") / bucket_turns),
        order=[F.col("turn")],
        columns=["turn", "role", "text"],
    )
    pairs = prev.filter((F.col("role") == "assistant") & (F.col("prev_role") == "user"))
    return pairs.select(
        "conv_id",
        F.col("prev_turn").alias("user_turn"),
        F.col("prev_text").alias("question"),
        F.col("text").alias("answer"),
    )


def followup_guard(threads: DataFrame, statements: DataFrame, thread_col: str = "conv_id") -> DataFrame:
    """H4: a follow-up on a thread whose statement has no transactions gets
    the fixed message; others get null (they go on to search/report)."""
    loaded = statements.select(F.col("statement_id").alias(thread_col)).distinct().withColumn("_has", F.lit(True))
    return threads.select(thread_col).distinct().join(loaded, thread_col, "left").select(
        thread_col,
        F.coalesce("_has", F.lit(False)).alias("has_statement"),
        F.when(F.col("_has").isNull(), F.lit(NO_STATEMENT)).alias("message"),
    )


def stage_status(statements: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """H5: the last stage each statement reached and the error that stopped
    it.  ``stages`` lists (stage name, frame of statement_id, error) in
    order; the first non-null error stops the statement there."""
    out = statements.select("statement_id").distinct().withColumn("stage", F.lit("start")).withColumn(
        "error", F.lit(None).cast("string")
    )
    for name, frame in stages:
        f = frame.select("statement_id", F.col("error").alias("_e"))
        out = out.join(f, "statement_id", "left").select(
            "statement_id",
            F.when(F.col("error").isNotNull(), F.col("stage"))
            .when(F.col("_e").isNotNull(), F.lit("error"))
            .otherwise(F.lit(name)).alias("stage"),
            F.coalesce("error", "_e").alias("error"),
        )
    return out
