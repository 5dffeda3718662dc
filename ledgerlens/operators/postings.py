"""A stored word index of transactions: written once, appended per batch, asked often.

Folders below the index path, one ``batch=<id>`` folder each per batch:

* ``postings``: per (statement, word, block) the number of transactions whose
  sentence holds the word and their ids with categories, in folders by word
  hash (``bucket``), so a search reads the folders of its words only;
* ``rows``: the transactions;  ``sizes``: transactions per statement.

A block is a range of ``width`` transaction ids, which bounds every list.
A batch that runs again replaces its own folders.  A transaction id belongs
to one batch; rows that share an id inside a batch count once.  Rows without
statement or id are counted in a statement's size and never found.

A batch is shuffled once, as transactions by (statement, block), over tasks
of about ``TASK_ROWS`` rows; words and lists are made inside these tasks.

Scores are those of ``search.question_hits``: shared words weighted by their
rarity in the statement.  ``search`` first reads only the counts, which give
the weights and, per block, the highest score a transaction there can reach.
Lists are read for the most promising blocks, then in rounds for more and more
of the blocks that can still reach the k-th score found, or tie with it by a smaller id.  No block
that could hold a hit is skipped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.operators.search import txn_sentences, words_of
from ledgerlens.schemas import TOP_K
from ledgerlens.sources.loader import written_frame

BUCKETS = 32  # word folders
WIDTH = 1 << 16  # transaction ids of a block
TASK_ROWS = 1 << 19  # transactions whose lists one task makes
FIRST_BLOCKS = 2  # blocks of a question that are read before a bound is known
GROWTH = 16  # each round reaches so many times further down a question's blocks


def _bucket(word: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def append_batch(txns: DataFrame, path: str, batch: int, key: str = "statement_id", buckets: int = BUCKETS,
                 width: int = WIDTH) -> None:
    """Write one batch of transactions to the index at ``path`` (made if absent).
    ``buckets`` and ``width`` are the same for all batches of an index."""
    block = F.floor(F.col("txn_id") / F.lit(width)).cast("bigint")
    spark = txns.sparkSession
    sizes = f"{path}/sizes/batch={batch}"
    txns.groupBy(key).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(sizes)
    n = spark.read.schema("n long").parquet(sizes).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    held = txns.filter(F.col(key).isNotNull() & F.col("txn_id").isNotNull()).withColumn("block", block)
    dealt = held.select(key, "block", "txn_id", "date", "description", "amount", "category").repartition(tasks, key, "block")
    spoken = txn_sentences(dealt).select(key, "txn_id", "category", "block", F.explode(words_of(F.col("content"))).alias("word"))
    lists = spoken.groupBy(key, "word", "block").agg(
        F.array_sort(F.collect_set(F.struct("txn_id", "category"))).alias("members"))
    lists = lists.withColumn("df", F.size(F.array_distinct("members.txn_id")).cast("bigint")).withColumn(
        "bucket", _bucket("word", buckets))
    lists.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    txns.withColumn("block", block).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")


def stored(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One table of the index.  An index that was never written or holds no
    transaction is an error, as is a search without an index."""
    try:
        sizes = spark.read.parquet(f"{path}/sizes")
    except AnalysisException as e:
        raise ValueError(f"no index at {path}") from e
    if sizes.isEmpty():
        raise ValueError(f"the index at {path} holds no transactions")
    return sizes if part == "sizes" else spark.read.parquet(f"{path}/{part}")


def _asked(questions: DataFrame, key: str, buckets: int) -> DataFrame:
    own = [c for c in (key, "filter_category") if c in questions.columns]
    words = questions.select("question_id", *own, F.explode(words_of(F.col("question"))).alias("word"))
    return words.withColumn("bucket", _bucket("word", buckets))


def postings_of(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The postings in the folders of the question words: at most as many
    folder numbers as the index has folders come to the driver."""
    folders = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
    return stored(spark, path, "postings").filter(F.col("bucket").isin(folders)).drop("batch", "bucket")


def _scores(lists: DataFrame, wanted: DataFrame, weights: DataFrame, meet: list[str], prefilter: bool) -> DataFrame:
    """Scores of the transactions in the wanted (statement, question, block)."""
    members = F.col("members")
    if prefilter:
        members = F.filter(members, lambda m: m["category"] == F.col("filter_category"))
    met = lists.join(weights.join(wanted, [meet[0], "question_id"]), [*meet, "block"])
    each = met.select(meet[0], "question_id", "block", "weight",
                      F.explode(F.array_distinct(F.transform(members, lambda m: m["txn_id"]))).alias("txn_id"))
    return each.groupBy(meet[0], "question_id", "block", "txn_id").agg(F.sum("weight").alias("got"))


def search(spark: SparkSession, path: str, questions: DataFrame, k: int = TOP_K, key: str = "statement_id",
           prefilter: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """The ``k`` best transactions of every (statement, question) from the index.

    ``questions`` has ``question_id`` and ``question``; with a column ``key``
    a question is put to that statement only, else to all.  With
    ``filter_category`` only transactions of that category are returned:
    of the best ``2 k`` (so fewer than ``k`` may be left), or with
    ``prefilter`` of all, so ``k`` whenever ``k`` share a word.  A null filter
    then lets none through (without the column, all pass)."""
    asked = _asked(questions, key, buckets)
    filtered = "filter_category" in asked.columns
    prefilter = prefilter and filtered
    fetch = 2 * k if filtered and not prefilter else k
    lists = postings_of(spark, path, asked)
    meet = [key, "word"]
    heads = lists.select(key, "word", "block", "df").join(asked.drop("bucket"), meet if key in asked.columns else ["word"])
    heads = written_frame(heads, "heads")  # counts only: read for the weights and for the bounds
    n = stored(spark, path, "sizes").groupBy(key).agg(F.sum("n").alias("n"))
    own = ["filter_category"] if filtered else []
    weights = heads.groupBy(key, "question_id", *own, "word").agg(F.sum("df").alias("df")).join(n, key)
    weights = written_frame(weights.withColumn(
        "weight", F.round(F.log(1.0 + F.col("n") / F.col("df").cast("double")) * 1_000_000).cast("bigint")).drop("n", "df"), "weights")
    whole = weights.groupBy(key, "question_id").agg(F.sum("weight").alias("whole"))

    ask = [key, "question_id"]
    held = heads.select(*ask, "word", "block").distinct()  # a block may be stored by several batches
    bounds = held.join(weights, [*ask, "word"]).groupBy(*ask, "block").agg(F.sum("weight").alias("bound"))
    order = Window.partitionBy(*ask).orderBy(F.desc("bound"), F.asc("block"))
    bounds = written_frame(bounds.withColumn("turn", F.row_number().over(order)), "bounds")
    best = Window.partitionBy(*ask).orderBy(F.desc("got"), F.asc("txn_id"))
    reach, left, top = FIRST_BLOCKS, bounds, None
    while True:
        now = written_frame(left.filter(F.col("turn") <= reach).drop("bound", "turn"), "blocks")
        scored = _scores(lists, now, weights, meet, prefilter)
        scored = scored if top is None else top.drop("rank").unionByName(scored)
        top = written_frame(
            scored.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= fetch), "best")
        least = top.filter(F.col("rank") == fetch).select(*ask, F.col("got").alias("least"), F.col("block").alias("last"))
        # Blocks after that of the fetch-th hit hold larger ids only: a tie there comes too late.
        left = left.filter(F.col("turn") > reach).join(least, ask, "left").filter(
            "least IS NULL OR bound > least OR (bound = least AND block <= last)")
        left = written_frame(left.drop("least", "last"), "blocks")
        if left.isEmpty():
            break
        reach *= GROWTH
    top = top.drop("block")
    distance = 2.0 - 2.0 * F.col("got").cast("double") / F.col("whole").cast("double")
    hits = top.join(whole, ask).withColumn("similarity_score", F.round(distance, 4)).drop("got", "whole")
    hits = written_frame(hits, "hits")
    rows = stored(spark, path, "rows").drop("batch", "block")
    found = hits.join(rows, [key, "txn_id"])
    if not filtered:
        return found
    found = found.join(questions.select("question_id", *[c for c in (key,) if c in questions.columns], "filter_category"),
                       ask if key in questions.columns else ["question_id"])
    found = found.filter(F.col("category") == F.col("filter_category")).drop("filter_category")
    again = Window.partitionBy(*ask).orderBy("rank")  # at most the fetched ranks
    return found.withColumn("rank", F.dense_rank().over(again).cast("bigint")).filter(F.col("rank") <= k)
