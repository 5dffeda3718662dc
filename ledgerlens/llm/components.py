"""Connected components of a table of links, in rounds of large-star and
small-star steps; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours link to its smallest one (or itself)."""
    both = links.select("a", "b").union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours link to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(``node``, ``root``) of every node of the links ``a``, ``b``; the root
    is the smallest node of the component.  The root itself is listed too."""
    stars = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(stars)
    for _ in range(max_rounds):
        stars = written(_small_star(_large_star(stars)), "links")
        before, state = state, _state(stars)
        if state == before:
            roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
