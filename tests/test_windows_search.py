import datetime as dt
import random

import numpy as np
from conftest import SF_SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions.windows import day_bucket, previous_row, running_totals
from ledgerlens.operators import search as V
from ledgerlens.sources import fixtures as X


def _random_txns(spark, n=3000, seed=3):
    rnd = random.Random(seed)
    d0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = 0 if rnd.random() < 0.4 else rnd.randint(1, 20)  # one hot key
        ts = d0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 40)) if rnd.random() > 0.02 else None
        rows.append((key, i, ts, rnd.randint(-500, 500)))
    return spark.createDataFrame(rows, "k long, id long, ts timestamp_ntz, v long")


def test_running_totals_equal_plain_window(spark):
    df = _random_txns(spark)
    got = running_totals(df, ["k"], day_bucket("ts"), [F.col("ts"), F.col("id")], {"s": F.col("v"), "n": F.lit(1)})
    w = Window.partitionBy("k").orderBy(F.col("ts").asc_nulls_first(), "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.sum("v").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n"))
    assert sorted(got.select("id", "s", "n").collect()) == sorted(want.collect())


def test_previous_row_equals_lag(spark):
    df = _random_txns(spark)
    got = previous_row(df, ["k"], day_bucket("ts"), [F.col("ts"), F.col("id")], ["id", "v"])
    w = Window.partitionBy("k").orderBy(F.col("ts").asc_nulls_first(), "id")
    want = df.select("id", F.lag("id").over(w).alias("prev_id"), F.lag("v").over(w).alias("prev_v"))
    assert sorted(got.select("id", "prev_id", "prev_v").collect()) == sorted(want.collect())


def test_with_position_balance(sample):
    rows = X.with_position(sample).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(1, 13))
    assert rows[0].balance == 4991.60 and rows[-1].balance == 6360.00


def test_knn_matches_numpy(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").withColumn("category", F.col("label").cast("string"))
    qs = X.label_centroids(emb)
    got = V.knn_batch(emb, qs, k=5).select("query_id", "rank", "vec_id").collect()
    e = emb.select("vec_id", "embedding").toPandas()
    mat = np.array(e.embedding.tolist(), dtype=np.float64)
    ids = e.vec_id.to_numpy()
    for q in qs.collect():
        d = ((mat - np.array(q.embedding)) ** 2).sum(axis=1)
        order = np.lexsort((ids, d))[:5]
        want = list(ids[order])
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q.query_id), key=lambda r: r.rank)] == want


def test_postfilter_may_return_fewer(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").withColumn("category", F.col("label").cast("string"))
    qs = X.label_centroids(emb).withColumn("filter_category", ((F.col("query_id") + 1) % 10).cast("string"))
    post = V.knn_postfilter(emb, qs).groupBy("query_id").count().collect()
    pre = V.knn_prefilter(emb, qs).groupBy("query_id").count().collect()
    assert all(r["count"] <= 5 for r in post)
    assert all(r["count"] == 5 for r in pre)
    top2k = {(r.query_id, r.vec_id) for r in V.knn_batch(emb, qs.select("query_id", "embedding"), k=10).collect()}
    assert {(r.query_id, r.vec_id) for r in V.knn_postfilter(emb, qs).collect()} <= top2k


def test_knn_in_several_blocks_equals_one(spark, monkeypatch):
    """Queries in several blocks give the same exact top-k as in one."""
    from ledgerlens.plans.catalog import _corpus, _questions

    corpus, questions = _corpus(spark, SF_SMALL), _questions(spark, SF_SMALL)
    cols = ["query_id", "rank", "vec_id", "similarity_score"]
    want_batch = sorted(V.knn_batch(corpus, questions).select(*cols).collect())
    want_pre = sorted(V.knn_prefilter(corpus, questions).select(*cols).collect())
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    assert sorted(V.knn_batch(corpus, questions).select(*cols).collect()) == want_batch
    assert sorted(V.knn_prefilter(corpus, questions).select(*cols).collect()) == want_pre
