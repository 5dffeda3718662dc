"""MinHash near-duplicates: bottom-k sketches from one hash function.

Two documents link when 5 * intersection >= 4 * union of their sets of word
shingles (any ``under / over``), confirmed on the full sets.

1. *Sketches.*  A shingle's number is its hash; the ``SKETCH`` smallest of a
   set are its sketch.  Equal sets are one node from here on.
2. *Inverted lists.*  Sketch values are counted over all sets, and every set
   keeps its rarest values: enough that a similar pair shares
   ``SHARED_LEAST`` of them (all, for the smallest sets).  Lists of at most
   ``SMALL_LIST`` sets count the overlaps of their pairs.  In longer lists
   every set links to the smallest of its size band, and neighbouring bands
   to each other, so a list of g sets makes about g links, never g*g.  The
   first of a band is found by a partial aggregate and handed back to salted
   groups.
3. *Candidate classes.*  Pairs whose overlap reaches the least, and the links
   of long lists, make classes; every similar pair is inside one.
4. *Blocks.*  The sets of a class meet in blocks of bounded size.  There the
   inverted lists are kept by class: a set meets only sets of other classes,
   the estimate from the union's sketch turns most away, and the exact
   similarity decides.  Split classes are joined as in ``set_classes``.

The estimate can turn a similar pair away with a probability below 1e-10 a
pair (sets of at most ``SKETCH`` tokens together: never); nothing is capped.

Defined cases: a null or blank text has no shingles, size 0, and links with
nothing; fewer than n words are one shingle; repeated rows are one node; null
ids are members of their class, and the class of only null ids has a null id
and a null ``kept``; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import written_small
from ledgerlens.llm.set_classes import (
    BLOCK_SHINGLES,
    class_links,
    dealt_sets,
    least_ids,
    shingle_table,
    star_links,
    with_times,
)
from ledgerlens.llm.sketch_join import SKETCH, least_shared, sketch_links

WORDS = 4
UNDER, OVER = 4, 5
SHARED_LEAST = 8
SMALL_LIST = 8


def retained_values(sets: DataFrame, under: int, over: int) -> DataFrame:
    """(``value``, ``times``, ``number``, ``n``, ``least``): the rare values
    that every set keeps, without those that no other set has; a similar pair
    shares at least the smaller ``least`` of them."""
    overlap = F.least(F.ceil(F.col("n") * under / over), F.lit(least_shared(under, over)))
    least = F.least(overlap, F.lit(SHARED_LEAST))
    postings = sets.select("number", "n", F.explode("sketch").alias("value"))
    shared = with_times(postings).groupBy("number", "n").agg(F.array_sort(F.collect_list(F.struct("times", "value"))).alias("held"))
    # Values of this set alone come first in the order and take their places.
    keep = F.size("held") - overlap + least
    return shared.where(keep > 0).select(
        "number", "n", least.alias("least"), F.explode(F.slice("held", F.lit(1), keep.cast("int"))).alias("h"),
    ).select("h.value", "h.times", "number", "n", "least")


def _pair_links(lists: DataFrame, under: int, over: int) -> DataFrame:
    """Pairs of sets that share enough values in short lists."""
    grouped = lists.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("number", "n", "least"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(
        F.slice("m", F.lit(1), i), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    near = (F.least("p.x.n", "p.y.n") * over >= F.greatest("p.x.n", "p.y.n") * under)
    return (
        grouped.select(F.explode(pairs).alias("p")).where(near)
        .groupBy(F.col("p.x.number").alias("a"), F.col("p.y.number").alias("b"))
        .agg(F.count(F.lit(1)).alias("shared"), F.first(F.least("p.x.least", "p.y.least")).alias("least"))
        .where("shared >= least").select("a", "b"))


def sketch_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, under: int = UNDER,
                   over: int = OVER, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row: the id, ``n_shingles``, ``component_id`` (the smallest
    id that links reach) and ``kept`` (whether it is the row's own)."""
    found = shingle_table(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words, SKETCH)
    sets = written_small(
        found.where("sketch IS NOT NULL").select("number", "n", "sketch").dropDuplicates(["number"]), "sketches")
    lists = written_small(retained_values(sets, under, over), "inverted-lists")
    candidates = _pair_links(lists.where(F.col("times") <= SMALL_LIST), under, over).union(
        star_links(lists.where(F.col("times") > SMALL_LIST), under, over))
    dealt, several = dealt_sets(found, candidates, block_shingles)
    links = class_links(dealt, several, sketch_links, under, over, block_shingles)
    return least_ids(found, links).select(
        F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
