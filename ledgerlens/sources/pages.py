"""Page scan and statement assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.text import py_strip


def scan_text_files(spark: SparkSession, path: str) -> DataFrame:
    """S1 for plain-text pages: one file = one page, the file name is the
    source, ``<statement>_...<page>.txt``.  The statement is the number the
    name starts with and the page the last number in it, read as numbers (so
    page 10 follows page 9); a name without one gives null and fails
    nothing; a file of no bytes gives no row.  A missing path raises Spark's PATH_NOT_FOUND, as a missing PDF
    raises in the reference."""
    number = lambda pattern: F.regexp_extract("source", pattern, 1).try_cast("bigint")
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("source"), F.coalesce("value", F.lit("")).alias("text"),
    ).select(
        number(r"^(\d+)_").alias("statement_id"),
        number(r"^\d+_.*?(\d+)\D*$").cast("int").alias("page_num"),
        "text", "source",
    )


def page_table(df: DataFrame, statement_col: str, page_col: str, text_col: str, source: F.Column) -> DataFrame:
    """S1 for a page table: 1-based page numbers, missing text -> ``""``."""
    return df.select(
        F.col(statement_col).cast("bigint").alias("statement_id"),
        (F.col(page_col) + 1).cast("int").alias("page_num"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        source.alias("source"),
    )


def combine_pages(pages: DataFrame) -> DataFrame:
    """Pages with non-blank text, joined unstripped with a blank line, in
    page order: one text per statement.  Pages are pre-projected to
    (page_num, text) before the shuffle; the group is one statement."""
    kept = pages.filter(py_strip(F.col("text")) != F.lit("")).select("statement_id", "page_num", "text")
    return kept.groupBy("statement_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("page_num", "text"))), lambda p: p["text"]),
            "\n\n",
        ).alias("raw_text"),
        F.count(F.lit(1)).alias("n_pages"),
    )
