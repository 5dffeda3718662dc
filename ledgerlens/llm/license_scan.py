"""License scan: ordered signature rules over whole texts (native Spark).

Each text becomes its words (A-Z lower-cased, runs of other ASCII
characters are borders), every word between two blanks of its own.  A text
without any of the gate stems costs one regular-expression pass and goes
no further.  The others are matched with the rules whose keyword is among
their words: the words that are keywords join the broadcast rule table (a
fixed list in ``license_rules.py``), and each rule runs once over the text.

Places come from splitting the text at the pattern: the words of the
pieces and matches before a match, summed in order, are its start.  Per
text, detections are then swept by (start, longest first, tier, rule): one
that lies inside an earlier one of the same or a better tier is
suppressed.  Only word counts and rule ids are shuffled, never texts.

Defined cases: a null or empty text has no words, no detections and score
0; rows that repeat or share an id are scanned on their own and each gives
a row; very long texts are scanned whole, their detections stream through
a sort; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.license_rules import GATE_STEMS, STATEMENT, Rule, rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BORDER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ANCHOR = ""


def rule_table(spark: SparkSession, listed: list[Rule]) -> DataFrame:
    """The rules as a relation; a rule without keyword stands for the text
    itself and keeps a row for texts without detections."""
    values = [f"(-1, '', 9, 0.0D, '{_ANCHOR}', '^$', false)"] + [
        f"({r.rule_id}, '{r.label}', {r.tier}, {r.score}D, '{r.keyword}', '{r.pattern}', {str(r.base).lower()})"
        for r in listed
    ]
    return spark.sql(
        f"SELECT * FROM VALUES {', '.join(values)} AS t(rule_id, label, tier, conf, keyword, pattern, is_base)"
    )


def _words_in(spaced: Column) -> Column:
    """Number of words of a piece of the scanned form (two blanks a word)."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def detections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               listed: list[Rule] | None = None) -> DataFrame:
    """All detections with word spans: ``text_row`` (a number of the input
    row), the id, ``n_words``, rule, ``start``, ``end`` (words from 0),
    ``kept`` (not suppressed).  Each input row also has one row whose rule
    id is -1."""
    listed = listed or rules()
    spark = df.sparkSession
    gate = rf"(?i)(^| )({'|'.join(GATE_STEMS)})"
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in listed})])
    texts = df.select(
        F.col(id_col),
        F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), _BORDER, " ")).alias("__plain"),
    ).select(
        id_col,
        F.monotonically_increasing_id().alias("text_row"),
        F.when(F.col("__plain") == "", F.lit(0)).otherwise(
            F.length("__plain") - F.length(F.replace("__plain", F.lit(" "), F.lit(""))) + 1
        ).cast("long").alias("n_words"),
        F.when(F.col("__plain").rlike(gate), F.translate("__plain", _UPPER, _LOWER)).alias("__low"),
    )
    present = F.array_intersect(F.split("__low", " "), keywords)
    hits = (
        texts.withColumn("keyword", F.explode(
            F.when(F.col("__low").isNull(), F.array(F.lit(_ANCHOR)))
            .otherwise(F.concat(F.array(F.lit(_ANCHOR)), present))))
        .withColumn("__form", F.concat(F.lit(" "), F.replace("__low", F.lit(" "), F.lit("  ")), F.lit(" ")))
        .join(F.broadcast(rule_table(spark, listed)), "keyword")
        .withColumn("__found", F.when(F.col("rule_id") >= 0, F.regexp_extract_all("__form", "pattern", F.lit(0))))
        .where((F.col("rule_id") < 0) | (F.size("__found") > 0))
    )
    pieces = F.arrays_zip(
        F.transform(F.split("__form", F.col("pattern")), _words_in).alias("before"),
        F.transform("__found", _words_in).alias("own"),
    )
    placed = hits.select(
        id_col, "text_row", "n_words", "rule_id", "label", "tier", "conf", "is_base",
        F.posexplode_outer(F.when(F.col("rule_id") >= 0, pieces)).alias("nth", "piece"),
    ).where((F.col("rule_id") < 0) | F.col("piece.own").isNotNull())
    # One shuffle for both windows and the aggregation of a text.
    placed = placed.repartition("text_row")
    so_far = Window.partitionBy("text_row", "rule_id").orderBy("nth")
    spans = placed.withColumn("end", F.sum(F.col("piece.before") + F.col("piece.own")).over(so_far)).withColumn(
        "start", F.col("end") - F.col("piece.own")
    )
    sweep = (
        Window.partitionBy("text_row")
        .orderBy(F.asc_nulls_first("start"), F.desc("end"), "tier", "rule_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = F.lit(-1)
    for tier in range(STATEMENT + 2):  # the furthest end among earlier detections of this tier or better
        ends = F.max(F.when(F.col("tier") <= tier, F.col("end"))).over(sweep)
        reach = F.when(F.col("tier") == tier, F.coalesce(ends, F.lit(-1))).otherwise(reach)
    return spans.withColumn("kept", (F.col("rule_id") >= 0) & (reach < F.col("end"))).drop("nth", "piece")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         listed: list[Rule] | None = None) -> DataFrame:
    """One row per input row: word count, places of base phrases, labels and
    the best confidence among detections that stay."""
    base = F.col("is_base")
    counted = F.col("kept") | base

    def joined(which: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.collect_set(F.when(which, F.col("label")))))

    return (
        detections(df, id_col, text_col, listed)
        .groupBy("text_row", id_col, "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            joined(base).alias("base_labels"),
            joined(counted).alias("labels"),
            F.coalesce(F.max(F.when(counted, F.col("conf"))), F.lit(0.0)).alias("score"),
        )
        .drop("text_row")
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _oracle() -> str:
    values = ", ".join(
        f"({r.rule_id}, '{r.label}', {r.tier}, {r.score}::DOUBLE, '{r.keyword}', '{r.pattern}', {str(r.base).lower()})"
        for r in rules()
    )
    return rf"""
WITH rules(rule_id, label, tier, conf, keyword, pattern, is_base) AS (VALUES {values}),
plain AS (
  SELECT doc_id, row_number() OVER () AS r,
         trim(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
              '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS p FROM documents),
texts AS (
  SELECT doc_id, r, ' ' || replace(p, ' ', '  ') || ' ' AS form,
         CASE WHEN p = '' THEN 0 ELSE length(p) - length(replace(p, ' ', '')) + 1 END AS n_words FROM plain),
hits AS (
  SELECT r, rules.*, regexp_extract_all(form, pattern) AS found, regexp_split_to_array(form, pattern) AS rest
  FROM texts, rules WHERE contains(form, ' ' || keyword || ' ') AND regexp_matches(form, pattern)),
nths AS (SELECT *, unnest(range(1, len(found) + 1)) AS nth FROM hits),
spans AS (
  SELECT r, rule_id, label, tier, conf, is_base,
         (length(own) - length(replace(own, ' ', ''))) // 2 AS n_own,
         (length(lead) - length(replace(lead, ' ', ''))) // 2 AS start_word
  FROM (SELECT *, found[nth] AS own,
               array_to_string(list_concat(found[1:nth - 1], rest[1:nth]), '') AS lead FROM nths)),
swept AS (
  SELECT *, start_word + n_own AS end_word, CASE tier
    WHEN 0 THEN max(CASE WHEN tier <= 0 THEN start_word + n_own END) OVER w
    WHEN 1 THEN max(CASE WHEN tier <= 1 THEN start_word + n_own END) OVER w
    WHEN 2 THEN max(CASE WHEN tier <= 2 THEN start_word + n_own END) OVER w
    ELSE max(start_word + n_own) OVER w END AS reach
  FROM spans
  WINDOW w AS (PARTITION BY r ORDER BY start_word, start_word + n_own DESC, tier, rule_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
per AS (
  SELECT r, count(*) FILTER (is_base) AS n_base, min(start_word) FILTER (is_base) AS first_word,
         max(start_word) FILTER (is_base) AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (is_base))), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label) FILTER (is_base OR coalesce(reach, -1) < end_word))), ',') AS labels,
         max(conf) FILTER (is_base OR coalesce(reach, -1) < end_word) AS score
  FROM swept GROUP BY r)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM texts LEFT JOIN per USING (r)
"""


SQL = _oracle()
