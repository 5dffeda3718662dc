"""Categorisation: batching, payloads, rule / model categorisers, reply map.

* Batches of 20 per statement follow ``txn_id`` order; the position is a
  skew-safe running count (``functions.windows``), not a window over the
  whole statement.
* The rule categoriser works on *distinct* descriptions: runs of
  description words are exploded and equi-joined to the patterns (adaptive
  execution broadcasts a rules table that it measures as small), the best
  rule per description wins by priority, and the (description -> category)
  map joins back.
* Model replies are parsed; a later answer for a description replaces an
  earlier one (``max_by`` over (batch, item)); unmatched descriptions get
  ``Other`` / 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.windows import running_totals
from ledgerlens.schemas import CATEGORIES, CATEGORY_BATCH, DEFAULT_CATEGORY

KEY = "statement_id"
_BETWEEN = r"[^\p{L}\p{N}&]+"  # what separates words of descriptions and patterns


def category_dim(spark: SparkSession) -> DataFrame:
    """The fixed category list with its order."""
    return spark.createDataFrame([(c, i) for i, c in enumerate(CATEGORIES)], "category string, ord int")


def category_list_text() -> Column:
    """The bullet list of categories given to a categoriser."""
    return F.lit("\n".join(f"- {c}" for c in CATEGORIES))


def distinct_descriptions(txns: DataFrame) -> DataFrame:
    """The descriptions to categorise, once each per statement."""
    return txns.groupBy(KEY, "description").agg(F.count(F.lit(1)).alias("n"))


def batches(txns: DataFrame, size: int = CATEGORY_BATCH, order: str = "txn_id") -> DataFrame:
    """``batch`` and ``item_idx`` of each transaction, in ``order``
    within its statement, ``size`` per batch."""
    bucket = F.floor(F.col(order) / F.lit(1 << 16))
    pos = running_totals(txns, [KEY], bucket, [F.col(order)], {"_pos": F.lit(1).cast("bigint")})
    return pos.withColumn("batch", F.floor((F.col("_pos") - 1) / size).cast("bigint")).withColumn(
        "item_idx", ((F.col("_pos") - 1) % size).cast("bigint")
    ).drop("_pos")


def json_string(c: Column) -> Column:
    """A JSON string literal of ``c`` (quotes and escapes)."""
    return F.regexp_replace(F.regexp_replace(F.to_json(F.array(c)), r"^\[", ""), r"\]$", "")


def batch_payload(batched: DataFrame) -> DataFrame:
    """C4: per batch, the request: the category list and the descriptions as
    an indented JSON array; each group holds at most ``CATEGORY_BATCH`` rows."""
    item = F.concat(F.lit('  {\n    "description": '), json_string(F.col("description")), F.lit("\n  }"))
    return batched.groupBy(KEY, "batch").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.first(category_list_text()).alias("categories"),
        F.concat(
            F.lit("[\n"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_idx", item.alias("j")))), lambda s: s["j"]), ",\n"),
            F.lit("\n]"),
        ).alias("payload"),
    )


def _spelled(text: Column) -> Column:
    """The upper-case words of a text, one blank between two."""
    return F.trim(F.regexp_replace(F.upper(text), _BETWEEN, " "))


def rule_map(descriptions: DataFrame, rules: DataFrame) -> DataFrame:
    """C5 (rules): (statement, description) -> best matching rule.  A rule
    matches when the words of its pattern (one or several, ``CORNER BOOKS``,
    ``EXAMPLE.COM``) stand in a row in the description, whatever the case;
    the lowest ``priority`` wins.  Every run of words that is as long as some
    pattern joins the patterns by equality."""
    r = rules.select(_spelled(F.col("pattern")).alias("phrase"), "category", "confidence", "priority").filter("phrase <> ''")
    lengths = r.agg(F.array_sort(F.collect_set(F.size(F.split("phrase", " ")))).alias("lengths"))  # one short row
    words = descriptions.select(KEY, "description", F.split(_spelled(F.col("description")), " ").alias("words"))
    runs = words.join(F.broadcast(lengths)).select(KEY, "description", F.explode(F.array_distinct(F.flatten(F.transform(
        F.filter("lengths", lambda n: n <= F.size("words")),
        lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " ")),
    )))).alias("phrase"))
    return runs.join(r, "phrase").groupBy(KEY, "description").agg(
        F.min_by(F.struct("category", "confidence"), F.struct("priority", "phrase")).alias("m")
    ).select(KEY, "description", F.col("m.category").alias("category"), F.col("m.confidence").alias("confidence"))


def apply_map(txns: DataFrame, cmap: DataFrame) -> DataFrame:
    """Exact description match; no match -> ``Other`` / 0.0; replaces
    any category the transaction had."""
    base = txns.drop("category", "confidence")
    joined = base.join(cmap.select(KEY, "description", "category", "confidence"), [KEY, "description"], "left")
    return joined.withColumn("category", F.coalesce("category", F.lit(DEFAULT_CATEGORY))).withColumn(
        "confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    )


def categorize_rules(txns: DataFrame, rules: DataFrame) -> DataFrame:
    """C5 + C7 with the rule categoriser."""
    return apply_map(txns, rule_map(distinct_descriptions(txns), rules))


def parse_category_replies(replies: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parse replies; returns (records, rejects).  ``strict`` fails the
    whole job on the first invalid reply, as the reference does."""
    from ledgerlens.operators.extract import json_records, repair_json

    parsed = replies.select(KEY, "batch", json_records(repair_json(F.col("raw"))).alias("records"))
    if strict:
        parsed = parsed.withColumn("records", F.coalesce(
            "records", F.raise_error(F.lit("a reply is not valid JSON")).cast("array<map<string,string>>")))
    rejects = parsed.filter(F.col("records").isNull()).select(KEY, "batch", F.lit("invalid json").alias("reason"))
    recs = parsed.filter(F.col("records").isNotNull()).select(
        KEY, "batch", F.posexplode("records").alias("item_idx", "r")
    )
    recs = recs.select(
        KEY, "batch", F.col("item_idx").cast("bigint").alias("item_idx"),
        F.col("r")["description"].alias("description"),
        F.coalesce(F.col("r")["category"], F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.coalesce(F.col("r")["confidence"].try_cast("double"), F.lit(0.0)).alias("confidence"),
    )
    return recs, rejects


def reply_map(records: DataFrame) -> DataFrame:
    """Last answer wins per (statement, description), by (batch, item)."""
    return records.groupBy(KEY, "description").agg(
        F.max_by(F.struct("category", "confidence"), F.struct("batch", "item_idx")).alias("m")
    ).select(KEY, "description", F.col("m.category").alias("category"), F.col("m.confidence").alias("confidence"))


def category_usage(spark: SparkSession, categorized: DataFrame) -> DataFrame:
    """C1 over data: each listed category with the number of transactions
    put in it (the 16-row dimension is broadcast by construction)."""
    counts = categorized.groupBy("category").agg(F.count(F.lit(1)).alias("n_txns"))
    return F.broadcast(category_dim(spark)).join(counts, "category", "left").select(
        "category", F.col("ord").cast("bigint").alias("ord"), F.coalesce("n_txns", F.lit(0)).cast("bigint").alias("n_txns")
    )


def category_unknown(spark: SparkSession, categorized: DataFrame) -> DataFrame:
    """Transactions whose category is not one of the listed ones."""
    return categorized.join(F.broadcast(category_dim(spark)).select("category"), "category", "left_anti")


def categorize_ml(train: DataFrame, txns: DataFrame, num_features: int = 1 << 12):
    """C5 (model): words -> hashed term counts -> logistic regression trained
    on labelled descriptions; confidence = highest class probability.
    Training is MLlib's distributed optimiser; prediction is a map."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IndexToString, RegexTokenizer, StringIndexer
    from pyspark.ml.functions import vector_to_array

    indexer = StringIndexer(inputCol="category", outputCol="label", handleInvalid="skip").fit(train)
    tok = RegexTokenizer(inputCol="description", outputCol="words", pattern=r"[^\p{L}\p{N}&]+")
    tf = HashingTF(inputCol="words", outputCol="features", numFeatures=num_features)
    lr = LogisticRegression(maxIter=50, regParam=0.01)
    fitted = Pipeline(stages=[tok, tf, lr]).fit(indexer.transform(train.select("description", "category")))
    to_name = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    scored = PipelineModel(stages=[*fitted.stages, to_name]).transform(txns.drop("category", "confidence"))
    return scored.select(
        *[c for c in txns.columns if c not in ("category", "confidence")],
        F.col("predicted").alias("category"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )
