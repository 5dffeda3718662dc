"""The category model on transactions that it was not trained on."""

from conftest import SF_SMALL
from pyspark.sql import functions as F

from ledgerlens.plans.catalog import QUERIES
from ledgerlens.sources import fixtures as X


def test_held_out_accuracy(spark):
    got = QUERIES["categorize_ml"](spark, SF_SMALL)
    truth = X.txn_ev(spark, SF_SMALL).select("txn_id", F.col("category").alias("truth"))
    r = got.join(truth, "txn_id").filter("held_out").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("category") == F.col("truth")).cast("double")).alias("right"),
        F.min("confidence").alias("low"), F.max("confidence").alias("high")).first()
    assert r["n"] > 100 and r["right"] >= 0.95
    assert 0.0 < r["low"] <= r["high"] <= 1.0
