"""Transaction views derived from the driver's tables (see FIXTURES.md).

The same definitions are written independently as SQL in
``oracle_sql.py``; both read the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.money import UNITS, rounded, units
from ledgerlens.functions.windows import day_bucket, running_totals
from ledgerlens.sources.tables import read_table, spread

OPENING_BALANCE = 5000  # dollars
LINES_PER_PAGE = 40
ITEMS_PER_REPLY = 20


def txn_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per event; ``user_id`` is the statement."""
    return txn_ev_frame(read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props"))


def stream_table(spark: SparkSession, sf_dir: str, name: str, key: str, files: int = 4) -> DataFrame:
    """The same table as a streaming source whose rows arrive out of order:
    dealt by a hash of ``key`` to files, one micro-batch each."""
    from ledgerlens.sources.loader import scratch_path

    table = read_table(spark, sf_dir, name)
    path = scratch_path(spark, f"stream-{name}")
    table.repartition(files, F.xxhash64(key)).write.parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def txn_ev_frame(ev: DataFrame) -> DataFrame:
    """``txn_ev`` from an events frame (batch or streaming)."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    amount = F.when(F.col("event_type") == "signup", F.col("value")).otherwise(-F.col("value"))
    return ev.select(
        F.col("user_id").alias("statement_id"),
        F.col("event_id").alias("txn_id"),
        F.col("ts"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.concat(F.upper("event_type"), F.lit(" "), (k % 10).cast("string")).alias("description"),
        F.col("event_type").alias("category"),
        amount.alias("amount"),
        F.when(amount > 0, "credit").otherwise("debit").alias("type"),
    )


def txn_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per line item; 50 statements by part key, brand as
    category, returned lines as credits.  The part side is a plain join:
    Spark broadcasts it only if its measured size is under the threshold."""
    li = read_table(
        spark, sf_dir, "lineitem",
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate",
    )
    return txn_li_frame(spread(li, "l_orderkey"), read_table(spark, sf_dir, "part", "p_partkey", "p_brand"))


def txn_li_frame(li: DataFrame, part: DataFrame) -> DataFrame:
    """``txn_li`` from a lineitem frame (batch or streaming) and the part table."""
    amount = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    return li.join(part, li.l_partkey == part.p_partkey, "inner").select(
        (F.col("l_partkey") % 50).alias("statement_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("txn_id"),
        F.col("l_shipdate").alias("ts"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("PART "), F.col("l_partkey").cast("string")).alias("description"),
        F.col("p_brand").alias("category"),
        amount.alias("amount"),
        F.when(amount > 0, "credit").otherwise("debit").alias("type"),
    )


def with_position(txns: DataFrame) -> DataFrame:
    """Add ``pos`` (1-based rank by ``ts, txn_id``) and ``balance`` (opening
    balance + running sum) per statement, skew-safe and exact."""
    out = running_totals(
        txns,
        keys=["statement_id"],
        bucket=day_bucket("ts"),
        order=[F.col("ts"), F.col("txn_id")],
        values={"pos": F.lit(1).cast("bigint"), "run_units": units("amount")},
    )
    return out.withColumn("balance", rounded(F.col("run_units") + F.lit(OPENING_BALANCE * UNITS))).drop(
        "run_units"
    )


def stmt_lines(txns: DataFrame) -> DataFrame:
    """Statement line text of each transaction, with its page number."""
    pos = with_position(txns)
    line = F.concat_ws(
        " ",
        F.col("date"),
        F.col("description"),
        F.concat(F.lit("$"), F.format_number("amount", 2)),
        F.concat(F.lit("$"), F.format_number("balance", 2)),
    )
    return pos.select(
        "statement_id",
        "pos",
        (F.floor((F.col("pos") - 1) / LINES_PER_PAGE) + 1).cast("int").alias("page_num"),
        line.alias("line"),
    )


def page_header(statement_id: str = "statement_id") -> F.Column:
    sid = F.col(statement_id)
    return F.concat(
        F.lit("Tidewater Savings | Account record\nAccount: "),
        (sid + F.lit(1000000000)).cast("string"),
        F.lit(" | Holder "),
        sid.cast("string"),
        F.lit(" | SSN: "),
        F.lpad((sid % 1000).cast("string"), 3, "0"),
        F.lit("-45-6789\nDate Description Amount Balance"),
    )


def stmt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement pages rendered from ``txn_ev``: header + 40 lines a page.
    Each page is one bounded group (40 lines)."""
    lines = stmt_lines(txn_ev(spark, sf_dir))
    body = lines.groupBy("statement_id", "page_num").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]),
            "\n",
        ).alias("body")
    )
    return body.select(
        "statement_id",
        "page_num",
        F.concat_ws("\n", page_header(), F.col("body")).alias("text"),
        F.concat(F.lit("statement_"), F.col("statement_id").cast("string"), F.lit(".pdf")).alias("source"),
    )


def raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for model replies: one JSON array per 20 transactions of a
    statement, fenced and with a trailing comma; amount ``"n/a"`` where
    ``txn_id % 97 = 0``."""
    pos = with_position(txn_ev(spark, sf_dir))
    item = F.to_json(F.struct("date", "description", "amount", "balance", "type"))
    item = F.when(
        F.col("txn_id") % 97 == 0,
        F.regexp_replace(item, '"amount":[^,}]*', '"amount":"n/a"'),
    ).otherwise(item)
    items = pos.select(
        "statement_id",
        F.floor((F.col("pos") - 1) / ITEMS_PER_REPLY).cast("int").alias("chunk_idx"),
        "pos",
        item.alias("item"),
    )
    return items.groupBy("statement_id", "chunk_idx").agg(
        F.concat(
            F.lit("```json\n[\n"),
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]),
                ",\n",
            ),
            F.lit(",\n]\n```"),
        ).alias("raw")
    )


NO_DATA = "Sorry, this page holds no transactions."


def raw_json_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_json``, with replies that hold nothing for every 50th statement."""
    return raw_json(spark, sf_dir).withColumn(
        "raw", F.when(F.col("statement_id") % 50 == 7, F.lit(NO_DATA)).otherwise(F.col("raw")))


def category_rules(spark: SparkSession) -> DataFrame:
    """Keyword and phrase rules for the rule-based categoriser (``ERROR`` has
    none, so it tests the ``Other`` default)."""
    return spark.createDataFrame(
        [
            ("PURCHASE", "Shopping", 0.9, 1),
            ("SIGNUP", "Income & Salary", 0.95, 2),
            ("VIEW", "Entertainment", 0.8, 3),
            ("CLICK", "Subscriptions", 0.85, 4),
            ("view 3", "Travel", 0.7, 0),
            ("CLICK.5", "Education", 0.6, 1),
        ],
        "pattern string, category string, confidence double, priority int",
    )


QUESTIONS = ("What did I receive for Brand#13 in December 1996?", "spent on part 7 of Brand#42")


def questions(spark: SparkSession) -> DataFrame:
    """Questions that are put to every statement."""
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id long, question string")


FILTERS = ("Brand#13", "Brand#24")


def filtered_questions(spark: SparkSession) -> DataFrame:
    """The questions, each for one category only."""
    return spark.createDataFrame(
        [(i, q, c) for i, (q, c) in enumerate(zip(QUESTIONS, FILTERS, strict=True))],
        "question_id long, question string, filter_category string")


# Invented names that the planted sentences hold.
PLANTED = " Seen http://10.0.0.1/u?tok=abc by Mira Solberg and Tomas Okafor."


def recognizers(spark: SparkSession) -> DataFrame:
    """The recogniser table of the queries: the defaults and two names."""
    from ledgerlens.operators.redact import RECOGNIZERS

    return spark.createDataFrame(
        [*RECOGNIZERS, ("PERSON", r"\b(?:Mira Solberg|Tomas Okafor)\b", 0.85)],
        "entity_type string, pattern string, score double")


def entity_documents(docs: DataFrame) -> DataFrame:
    """Documents, every 50th with a planted sentence (an address inside a
    URL, two names)."""
    return docs.withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit(PLANTED))).otherwise(F.col("text")))


def label_centroids(embeddings: DataFrame) -> DataFrame:
    """Questions for the search operators: the unit-length mean vector of
    each label (derived from the whole table; one row per label)."""
    dims = embeddings.select(
        "label", F.posexplode("embedding").alias("i", "x")
    ).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vec = dims.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v")
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    return vec.select(
        F.col("label").cast("bigint").alias("query_id"),
        F.transform("v", lambda x: x / norm).alias("embedding"),
    )


# Category a stand-in categoriser answers per event type (others: Other).
REPLY_CATEGORY = {
    "purchase": "Shopping",
    "signup": "Income & Salary",
    "view": "Entertainment",
    "click": "Subscriptions",
}


def category_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for categoriser replies: per batch of 20 transactions of a
    statement (by ``txn_id``), a fenced JSON array of
    (description, category, confidence); the reply of a batch holding a
    ``txn_id % 97 = 0`` has an unclosed record, i.e. is invalid JSON."""
    from ledgerlens.operators.categorize import batches

    b = batches(txn_ev(spark, sf_dir))
    cat = F.coalesce(
        F.create_map(*[F.lit(x) for kv in REPLY_CATEGORY.items() for x in kv])[F.col("category")],
        F.lit("Other"),
    )
    conf = ((F.col("txn_id") % 50) + 50) / F.lit(100.0)
    item = F.to_json(F.struct(F.col("description"), cat.alias("category"), conf.alias("confidence")))
    item = F.when(F.col("txn_id") % 97 == 0, F.regexp_replace(item, r"\}$", "")).otherwise(item)
    return b.groupBy("statement_id", "batch").agg(
        F.concat(
            F.lit("```json\n[\n"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_idx", item.alias("j")))), lambda s: s["j"]), ",\n"),
            F.lit(",\n]\n```"),
        ).alias("raw")
    )
