"""Exact duplicates by a tree merge of sorted digest runs (native Spark).

Every row becomes (digest, normalised length, order key).  Rows are dealt
to ``LEAF_RUNS`` runs; each run is aggregated by digest with a sort (one
sorted digest run per run number), and runs then meet in rounds: in each
round ``2**FAN_BITS`` neighbouring runs merge into one, keeping per digest
the smallest order key and the number of rows, until one run per digest is
left.  The length of the normalised text is part of every merge key, so a
digest is only merged with rows that it was verified against.

The digest space itself stays hash partitioned in every round, so no task
ever holds a whole level, and a digest that holds a third of all rows
reaches its last merge as at most ``LEAF_RUNS`` rows.  Going back down,
the final row of a digest joins its leaf runs (at most ``LEAF_RUNS`` rows
per digest) and the rows join their own (digest, run), so the hot digest
is spread over all runs there as well.

Defined cases: a null text counts as empty; a null id sorts after all
others; repeated rows (same id, same text) are separate members of the
group and exactly one of them stays; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import BLANKS, written
from ledgerlens.session import cut_lineage

LEAF_BITS = 6
LEAF_RUNS = 1 << LEAF_BITS
FAN_BITS = 3
MARK_BITS = 24  # a bit map of 2 MB of the digests that several rows have


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with their digest, verified length, order key and leaf run."""
    norm = normalised(F.col(text_col))
    return (
        df.withColumn("__norm", norm)
        .withColumn("__sha", F.unhex(F.sha2(F.col("__norm"), 256)))
        .withColumn("__len", F.octet_length("__norm"))
        .drop("__norm")
        .withColumn("__neg", -F.char_length(F.coalesce(F.col(text_col), F.lit(""))))
        .withColumn("__run", F.pmod(F.xxhash64(F.col(id_col)), F.lit(LEAF_RUNS)).cast("int"))
    )


def leaf_runs(keyed: DataFrame, order: Column) -> DataFrame:
    return keyed.groupBy("__sha", "__len", "__run").agg(
        F.min(order).alias("__best"), F.count(F.lit(1)).alias("__size")
    )


def _merge_rounds(leaf: DataFrame) -> DataFrame:
    """Up the tree: one row per digest with its smallest order key and size."""
    runs, shift = leaf, 0
    while shift < LEAF_BITS:
        shift = min(LEAF_BITS, shift + FAN_BITS)
        step = FAN_BITS if shift % FAN_BITS == 0 else shift % FAN_BITS
        runs = (
            runs.withColumn("__run", F.shiftright("__run", step))
            .groupBy("__sha", "__len", "__run")
            .agg(F.min("__best").alias("__best"), F.sum("__size").alias("__size"))
        )
    return runs.drop("__run")


def spread_down(leaf: DataFrame) -> DataFrame:
    """Every leaf run with the final row of its digest."""
    return leaf.select("__sha", "__len", "__run").join(_merge_rounds(leaf), ["__sha", "__len"])


def dedup_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id`` (id of the row that stays),
    ``group_size``, ``kept``, ``text_sha256``."""
    rows = _keyed(df.select(id_col, text_col), id_col, text_col).drop(text_col)
    # Written once: the row number that separates repeated rows is fixed from here on.
    rows = cut_lineage(rows.withColumn("__row", F.monotonically_increasing_id()))
    order = F.struct("__neg", F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), "__row")
    found = rows.join(spread_down(leaf_runs(rows, order)), ["__sha", "__len", "__run"])
    return found.select(
        F.col(id_col),
        F.col("__best.id").alias("keep_id"),
        F.col("__size").alias("group_size"),
        (F.col("__row") == F.col("__best.__row")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def by_marks(df: DataFrame, digest: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose digest is not among those of ``wanted`` (its
    only column), and the rows whose digest may be.  They are told apart by a
    bit map of bounded size, so that few of the first kind are shuffled; a
    join decides on the second."""
    mark = F.shiftrightunsigned(F.xxhash64(digest), 64 - MARK_BITS)
    bits = wanted.select(F.shiftrightunsigned(F.xxhash64(wanted.columns[0]), 64 - MARK_BITS).alias("mark")).groupBy(
        F.shiftright("mark", 6).alias("__place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(mark & 63 as int))")).alias("__bits"))
    placed = df.withColumn("__mark", mark).withColumn("__place", F.shiftright("__mark", 6))
    looked = placed.join(F.broadcast(bits), "__place", "left").withColumn(
        "__may", F.expr("(shiftrightunsigned(coalesce(__bits, 0L), cast(__mark & 63 as int)) & 1) = 1"))
    return looked.where("NOT __may").select(*df.columns), looked.where("__may").select(*df.columns)


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with the columns of ``df``.  Of repeated
    rows with one id and one text an arbitrary one stays.

    A row whose digest no other row has stays where it is: only rows whose
    digest may be one of several rows (by a bit map) are shuffled, and the
    join decides on them."""
    # The whole row travels as one struct, so no column name can clash.
    whole = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = _keyed(whole, "id", "text").drop("text")
    order = F.struct("__neg", F.col("id").isNull().alias("n"), "id")
    groups = spread_down(leaf_runs(cut_lineage(keyed.drop("row")), order))
    found = written(groups.where("__size > 1").drop("__size"), "several")
    alone, some = by_marks(keyed, F.col("__sha"), found.select("__sha"))
    # The best key is the smallest of the group, so "not larger" means equal;
    # stated so, the join stays on (digest, length, run), and since the run is
    # a function of the id, dropping repeated rows needs no further shuffle.
    best = (F.col("__neg") <= F.col("__best.__neg")) & (F.col("__best.id").isNull() | (F.col("id") <= F.col("__best.id")))
    met = some.join(found, ["__sha", "__len", "__run"], "left")
    stays = met.where(F.col("__best").isNull() | best).dropDuplicates(["__sha", "__len", "__run", "id"])
    return alone.select("row.*").union(stays.select("row.*"))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
