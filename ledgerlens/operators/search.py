"""Similarity search over embedding columns (``array<float>``).

Exact top-k is a scan of the corpus against the query vectors in blocks
(``_pairs``): any number of queries, no row bound, nothing collected.  For
one query, ``orderBy(dist).limit(k)`` becomes TakeOrderedAndProject (a top-k
per partition, then a merge).  For many, ``row_number() <= k`` per query
becomes WindowGroupLimit, which also cuts each partition to k rows per
query *before* the shuffle.  Distance is squared L2 (smaller = nearer),
reported as ``similarity_score`` rounded to 4 places, as the reference's
flat index does.  LSH gives the approximate variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.anomalies import fixed2
from ledgerlens.schemas import TOP_K
from ledgerlens.sources.loader import written_frame


def sq_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed left to right in double."""
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, d: acc + d)


def normalize(v: Column) -> Column:
    """Unit length (L2); a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def txn_sentences(txns: DataFrame) -> DataFrame:
    """V1: ``date | description | spent/received $x.xx | category: c``."""
    verb = F.when(F.col("amount") < 0, F.lit("spent")).otherwise(F.lit("received"))
    content = F.concat_ws(
        " | ",
        F.col("date"),
        F.col("description"),
        F.concat(verb, F.lit(" $"), fixed2(F.abs(F.col("amount")))),
        F.concat(F.lit("category: "), F.coalesce(F.col("category"), F.lit("Unknown"))),
    )
    return txns.withColumn("content", content)


def txn_metadata(txns: DataFrame) -> DataFrame:
    """V2: the seven metadata fields with their defaults."""
    def opt(name: str, default, dtype: str) -> Column:
        if name in txns.columns:
            return F.coalesce(F.col(name).cast(dtype), F.lit(default).cast(dtype)) if default is not None else F.col(name).cast(dtype)
        return F.lit(default).cast(dtype)

    return txns.select(
        *[c for c in ("statement_id", "txn_id") if c in txns.columns],
        opt("date", "", "string").alias("date"),
        opt("description", "", "string").alias("description"),
        opt("amount", 0.0, "double").alias("amount"),
        opt("type", "", "string").alias("type"),
        opt("category", "Other", "string").alias("category"),
        opt("confidence", 0.0, "double").alias("confidence"),
        opt("balance", None, "double").alias("balance"),
    )


def words_of(text: Column) -> Column:
    """The distinct lower-case words (letters and digits) of a text."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: w != F.lit(""))


WORD_BITS = 64  # question words that share one mask


def _word_masks(spoken: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Per transaction and band of question words: which of them it holds, as
    the bits of a long.  Rows that share a transaction id count once."""
    words = asked.select("word", "band", "bit").distinct()
    bits = spoken.join(words, "word").select(key, "txn_id", "band", F.expr("shiftleft(1L, bit)").alias("held"))
    return bits.groupBy(key, "txn_id", "band").agg(F.bit_or("held").alias("mask"))


def _mask_scores(kinds: DataFrame, asked: DataFrame, sizes: DataFrame, key: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Weight of each question's words that a mask holds (``got``), for the
    masks that a hit can have, and the weight of all words that occur.

    ``kinds`` counts the transactions of a statement by mask.  The k-th best
    score in one band is a bound from below (``least``): a hit's other bands
    add at most their best score, so a mask that stays below it is no hit's."""
    asks = [key, "question_id"]
    met = kinds.join(asked, "band").filter(F.expr("shiftrightunsigned(mask, bit) & 1L") == 1)
    rarity = (
        met.groupBy(*asks, "band", "bit").agg(F.sum("n").alias("df")).join(sizes, key)
        .withColumn("weight", F.round(F.log(1.0 + F.col("size") / F.col("df").cast("double")) * 1_000_000).cast("bigint"))
        .drop("size", "df")
    )
    whole = rarity.groupBy(*asks).agg(F.sum("weight").alias("whole"))
    got = met.join(rarity, [*asks, "band", "bit"]).groupBy(*asks, "band", "mask", "n").agg(F.sum("weight").alias("got"))
    falling = Window.partitionBy(*asks, "band").orderBy(F.desc("got"))
    steps = got.groupBy(*asks, "band", "got").agg(F.sum("n").alias("n")).withColumn("above", F.sum("n").over(falling))
    bands = steps.groupBy(*asks, "band").agg(
        F.max("got").alias("best"), F.max(F.when(F.col("above") >= k, F.col("got"))).alias("least"))
    bounds = bands.groupBy(*asks).agg(F.sum("best").alias("all_best"), F.max("least").alias("least"))
    keep = got.join(bands.drop("least"), [*asks, "band"]).join(bounds, asks).filter(
        F.col("least").isNull() | (F.col("got") + F.col("all_best") - F.col("best") >= F.col("least")))
    return keep.select(*asks, "band", "mask", "got"), whole


def question_hits(txns: DataFrame, questions: DataFrame, k: int = TOP_K, key: str = "statement_id") -> DataFrame:
    """Search by question text: the ``k`` nearest transactions of every
    (statement, question), with their columns, ``rank`` and
    ``similarity_score`` (smaller is nearer, as squared L2 of unit vectors).

    Transactions and questions share one sparse space: words weighted by
    their rarity in the statement, ``ln(1 + n / df)`` in millionths, so that
    sums are exact.  Only transactions that share a word are scored; the distance
    is ``2 - 2 * (weight of the shared words / weight of the question's words)``.

    A transaction's shared words are one mask (the distinct question words are
    numbered in one task), shuffled once by transaction.  The masks are counted
    per statement, which gives the weights and the masks that a hit can have;
    only transactions with these are ranked.  No statement, word or question is
    one task's group.
    """
    asked = questions.filter(F.col("question_id").isNotNull()).select(
        "question_id", F.explode(words_of(F.col("question"))).alias("word")).distinct()
    number = asked.select("word").distinct().withColumn("number", F.row_number().over(Window.orderBy("word")) - 1)
    asked = written_frame(
        asked.join(number.withColumn("band", F.expr(f"number div {WORD_BITS}")).withColumn(
            "bit", (F.col("number") % WORD_BITS).cast("int")).drop("number"), "word"), "question-words")
    of_key = txns.filter(F.col(key).isNotNull())
    spoken = txn_sentences(of_key).select(key, "txn_id", F.explode(words_of(F.col("content"))).alias("word"))
    masks = written_frame(_word_masks(spoken, asked, key), "word-masks")
    sizes = of_key.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    kinds = masks.groupBy(key, "band", "mask").agg(F.count(F.lit(1)).alias("n"))
    keep, whole = _mask_scores(written_frame(kinds, "mask-kinds"), asked.drop("word"), written_frame(sizes, "sizes"), key, k)
    scored = masks.join(written_frame(keep, "mask-scores"), [key, "band", "mask"]).groupBy(key, "question_id", "txn_id").agg(
        F.sum("got").alias("got"))
    w = Window.partitionBy(key, "question_id").orderBy(F.desc("got"), F.asc("txn_id"))
    top = scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).join(
        whole, [key, "question_id"])
    distance = 2.0 - 2.0 * F.col("got").cast("double") / F.col("whole").cast("double")
    top = written_frame(top.withColumn("similarity_score", F.round(distance, 4)).drop("got", "whole"), "hits")
    return top.join(txns, [key, "txn_id"])


QUERY_BLOCK = 1024  # query vectors that travel together
CORPUS_PARTS = 64  # parts of the corpus that a query block visits


def _pairs(corpus: DataFrame, queries: DataFrame, id_col: str, on: tuple[str, str] | None = None) -> DataFrame:
    """Every corpus row with every query (or with those whose second column
    of ``on`` equals its first), in blocks: the query set is dealt to blocks
    of about ``QUERY_BLOCK`` rows, a block is one row and visits every part of
    the corpus by an equality join.  Any number of queries, no broadcast
    beyond what adaptive execution measures as small."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    left = corpus.withColumn("__part", F.pmod(F.xxhash64(id_col), F.lit(CORPUS_PARTS))).withColumn(
        "__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = queries.withColumn("__block", F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)).cast("int"))
    packed = dealt.groupBy("__block").agg(F.collect_list(F.struct(*queries.columns)).alias("__queries")).withColumn(
        "__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(CORPUS_PARTS - 1).cast("bigint"))))
    wanted = F.col("__queries")
    if on:
        wanted = F.filter(wanted, lambda q: q[on[1]] == F.col(on[0]))
    met = left.join(packed, ["__block", "__part"]).withColumn("__q", F.explode(wanted))
    return met.select(*corpus.columns, "__q.*")


def knn(corpus: DataFrame, query: DataFrame, k: int = TOP_K, id_col: str = "vec_id") -> DataFrame:
    """V5: the k nearest corpus rows to the single query vector
    (``query`` has one row with column ``q``); ties broken by id."""
    q = query.select(F.col("embedding").alias("q"))
    if q.limit(2).count() != 1:
        raise ValueError("knn takes one query vector; use knn_batch for several")
    scored = _pairs(corpus, q, id_col).withColumn("dist", sq_l2(F.col("embedding"), F.col("q"))).drop("q")
    top = scored.orderBy(F.col("dist"), F.col(id_col)).limit(k)
    w = Window.orderBy(F.col("dist"), F.col(id_col))  # over k rows only
    return top.withColumn("rank", F.row_number().over(w).cast("bigint")).withColumn(
        "similarity_score", F.round("dist", 4)
    )


def knn_batch(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "vec_id") -> DataFrame:
    """V6: top k per query for a batch of queries (``query_id``, ``embedding``)."""
    q = queries.select("query_id", F.col("embedding").alias("q"))
    scored = _pairs(corpus, q, id_col).withColumn("dist", sq_l2(F.col("embedding"), F.col("q"))).drop("q")
    w = Window.partitionBy("query_id").orderBy(F.col("dist"), F.col(id_col))
    ranked = scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
    return ranked.withColumn("similarity_score", F.round("dist", 4))


def knn_postfilter(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, category_col: str = "category",
                   id_col: str = "vec_id") -> DataFrame:
    """V7: fetch 2k, keep the query's ``filter_category``, cut to k: may
    return fewer than k although more matching rows exist."""
    top2k = knn_batch(corpus, queries.select("query_id", "embedding"), 2 * k, id_col)
    f = top2k.join(queries.select("query_id", "filter_category"), "query_id").filter(
        F.col(category_col) == F.col("filter_category")
    )
    w = Window.partitionBy("query_id").orderBy(F.col("rank"))  # at most 2k rows per query
    return f.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).drop("filter_category")


def knn_prefilter(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, category_col: str = "category",
                  id_col: str = "vec_id") -> DataFrame:
    """V8: filter on the category first, then top k: always k when k exist."""
    q = queries.select("query_id", F.col("embedding").alias("q"), "filter_category")
    scored = _pairs(corpus, q, id_col, (category_col, "filter_category"))
    scored = scored.withColumn("dist", sq_l2(F.col("embedding"), F.col("q"))).drop("q", "filter_category")
    w = Window.partitionBy("query_id").orderBy(F.col("dist"), F.col(id_col))
    ranked = scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
    return ranked.withColumn("similarity_score", F.round("dist", 4))


def knn_lsh(corpus: DataFrame, query_vec: list[float], k: int = TOP_K, bucket_length: float = 1.0,
            num_tables: int = 5, id_col: str = "vec_id", seed: int = 7) -> DataFrame:
    """V9: approximate nearest neighbours with random-projection LSH
    (MLlib); the distance column is the plain L2 distance."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    vec = corpus.withColumn("features", array_to_vector(F.col("embedding")))
    model = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=num_tables, seed=seed
    ).fit(vec)
    found = model.approxNearestNeighbors(vec, Vectors.dense(query_vec), k, distCol="l2")
    return found.select(id_col, *[c for c in corpus.columns if c not in (id_col, "embedding")], "l2")
