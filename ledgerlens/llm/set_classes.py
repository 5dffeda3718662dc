"""What the joins of similar sets share: the table of sets, inverted lists,
blocks of candidate classes, and the smallest id of every class.

A set is known by its 64-bit number, so rows with equal sets are one node.
Rows never meet by their ids: null or repeated ids cost nothing extra.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import written_small
from ledgerlens.llm.components import components
from ledgerlens.llm.shingles import set_number, shingle_sets, text_batches

INSERT, ASK, BOTH = 0, 1, 2  # roles of a set in a block
SALTS = 64
BLOCK_SHINGLES = 1 << 21  # 16 MB of tokens
SEEN_SETS = 1 << 20
HOT_TIMES = 1024  # sets of a value that is looked up in the broadcast list
HOT_VALUES = 1 << 16  # entries of that list (1 MB)
MARK_BITS = 24  # a bit map of 2 MB of the sets that are asked for

FINER_ROUNDS = 3

BlockLinks = Callable[[list, int, int], list[tuple[int, int]]]
# (sets as number, class and, where they are stored, rest; round) -> candidate links inside the classes
FinerLinks = Callable[[DataFrame, int], DataFrame]
# numbers -> (number, sketch, rest) of at least these sets
SetsOf = Callable[[DataFrame], DataFrame]


class Once:
    """Whether a set number is new to a task (bounded: an old one may be new again)."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, number: int | None) -> bool:
        if number is None or number in self.seen:
            return False
        if len(self.seen) > SEEN_SETS:
            self.seen.clear()
        self.seen.add(number)
        return True


def made_sets(batches: Iterator[pa.RecordBatch], words: int, text_at: int = 0):
    """(other columns, sets, numbers) of rows of texts; no number for an empty set."""
    for others, chunk in text_batches(batches, text_at):
        sets = shingle_sets(chunk, words)
        yield others, sets, [set_number(s) if len(s) else None for s in sets]


def shingle_table(texts: DataFrame, words: int, low: int = 0) -> DataFrame:
    """A written table with a row per row of ``texts`` (``id``, ``text``): id,
    ``n`` (set size), ``number`` (null for an empty set) and, once per set and
    task, its sorted tokens: the ``low`` smallest as ``sketch``, the others
    packed as ``rest``."""
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches):
        kind, new = None, Once()

        def noting():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for ids, sets, numbers in made_sets(noting(), words, 1):
            sketch, rest = [None] * len(sets), [None] * len(sets)
            for i, (number, own) in enumerate(zip(numbers, sets, strict=True)):
                if new(number):
                    sketch[i], rest[i] = own[:low].view(np.int64), own[low:].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([i[0] for i in ids], kind), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array(numbers, pa.int64()), pa.array(sketch, pa.list_(pa.int64())), pa.array(rest, pa.binary())],
                ["id", "n", "number", "sketch", "rest"])

    shape = f"id {id_type}, n int, number long, sketch array<long>, rest binary"
    return written_small(texts.select("id", "text").mapInArrow(run, shape), "shingle-sets")


def made_again(texts: DataFrame, words: int) -> DataFrame:
    """(``number``, ``sketch``, ``rest``) of the sets of ``text``, once per
    set and task: nothing is stored."""

    def run(batches):
        new = Once()
        for _, sets, numbers in made_sets(batches, words):
            own = [(number, s.tobytes()) for number, s in zip(numbers, sets, strict=True) if new(number)]
            if own:
                number, rest = zip(*own, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number, pa.int64()), pa.array([[]] * len(own), pa.list_(pa.int64())), pa.array(rest, pa.binary())],
                    ["number", "sketch", "rest"])

    return texts.select("text").mapInArrow(run, "number long, sketch array<long>, rest binary")


def with_least(df: DataFrame, keys: list[str], value: Column, name: str, salt: Column) -> DataFrame:
    """``df`` with the smallest ``value`` of each key, nulls last.  A key of
    any number of rows is dealt by ``salt`` to at most ``SALTS`` groups: rows
    meet one of them, never the whole key."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    leaf = salted.groupBy(*keys, "__salt").agg(F.min(value).alias(name))
    least = leaf.groupBy(*keys).agg(F.min(name).alias(name))
    return salted.join(leaf.select(*keys, "__salt").join(least, keys), [*keys, "__salt"]).drop("__salt")


def with_times(postings: DataFrame) -> DataFrame:
    """``postings`` whose value is in several sets, with their number.  The
    most frequent values come from a bounded broadcast list, all others by a
    join in which no value is frequent."""
    times = written_small(postings.groupBy("value").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "value-counts")
    hot = times.where(F.col("times") >= HOT_TIMES).orderBy(F.desc("times"), "value").limit(HOT_VALUES)
    looked = postings.join(F.broadcast(hot), "value", "left")
    cold = times.join(F.broadcast(hot.select("value")), "value", "left_anti")
    return looked.where("times IS NOT NULL").unionByName(looked.where("times IS NULL").drop("times").join(cold, "value"))


def hot_values(some: DataFrame, share: int) -> DataFrame:
    """Values that about ``HOT_TIMES`` sets have or more, judged by the
    postings of one set in ``share``; at most ``HOT_VALUES``."""
    times = some.groupBy("value").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") * share >= HOT_TIMES)
    return times.orderBy(F.desc("times"), "value").limit(HOT_VALUES).select("value")


def shared_postings(postings: DataFrame, hot: DataFrame) -> DataFrame:
    """``postings`` whose value is in several sets, with their number: one
    shuffle by value counts them where they meet (a set that several tasks
    wrote is no several sets).  ``hot`` values are dealt to
    ``SALTS`` groups each and have ``HOT_TIMES`` for their number; the list
    only spreads the rows."""
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("number"), F.lit(SALTS)).cast("int")).otherwise(-1)
    dealt = postings.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "value", "left").withColumn("salt", salt).drop("hot")
    group = Window.partitionBy("value", "salt")
    met = dealt.withColumn("several", F.min("number").over(group) < F.max("number").over(group)).withColumn(
        "times", F.count(F.lit(1)).over(group))
    return met.where("several OR salt >= 0").withColumn(
        "times", F.when(F.col("salt") >= 0, F.lit(HOT_TIMES).cast("long")).otherwise(F.col("times"))).drop("salt", "several")


def star_links(lists: DataFrame, under: int, over: int) -> DataFrame:
    """Links of long lists: every set to the smallest of its size band,
    bands to the next."""
    width = float(np.log(over / under) * (1 + 1e-9))  # similar sets are in one band or the next
    banded = lists.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
    placed = with_least(banded, ["value", "band"], F.col("number"), "first", F.col("number"))
    # One link per set and first of a list would be many: the firsts that a
    # set meets are linked to the smallest of them.
    firsts = placed.groupBy("number").agg(F.collect_set("first").alias("firsts"))
    least = F.array_min("firsts")
    met = firsts.select(least.alias("b"), F.explode(F.array_union(F.array("number"), "firsts")).alias("a"))
    ends = banded.groupBy("value", "band").agg(F.min("number").alias("first"))
    above = ends.select("value", (F.col("band") - 1).alias("band"), F.col("first").alias("a"))
    return met.select("a", "b").union(ends.join(above, ["value", "band"]).select("a", F.col("first").alias("b"))).where(
        "a <> b").distinct()


def marked(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``number`` may be among those of ``wanted``:
    a bit map of fixed size, so that few of the other sets are shuffled.  Any
    number of wanted sets is right; the join that follows decides."""
    mark = F.shiftrightunsigned(F.xxhash64("number"), 64 - MARK_BITS).cast("int").alias("mark")
    words = wanted.select(mark).groupBy(F.shiftright("mark", 6).alias("place")).agg(
        F.bit_or(F.expr("shiftleft(1L, mark & 63)")).alias("bits")).toArrow()
    bits = np.zeros(1 << (MARK_BITS - 6), np.int64)
    bits[words["place"].to_numpy()] = words["bits"].to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def may_be(marks: pd.Series) -> pd.Series:
        m = marks.to_numpy().astype(np.int64)
        return pd.Series((shared.value[m >> 6] >> (m & 63) & 1).astype(bool))

    return df.where(may_be(mark))


def finer_classes(found: DataFrame, member: DataFrame, finer: FinerLinks, block_shingles: int,
                  sets: SetsOf | None = None) -> DataFrame:
    """``member`` (number, class, n) with its classes of more than
    ``block_shingles`` tokens made anew from the links that ``finer`` finds
    among their sets (which are handed on with their numbers unless ``sets``
    makes them anew).  Similar sets stay together, sets without a link leave;
    a round that keeps most of the tokens is the last."""
    before = None
    for turn in range(1, FINER_ROUNDS + 1):
        large = written_small(
            member.groupBy("class").agg(F.sum("n").alias("tokens")).where(F.col("tokens") > block_shingles), "large-classes")
        total = large.agg(F.sum("tokens")).first()[0]
        if not total or before and 2 * total > before:
            break
        before = total
        large = F.broadcast(large.select("class"))  # at most a class for every block_shingles tokens
        split = written_small(member.join(large, "class"), "large-members")
        part = split.select("number", "class")
        if not sets:
            part = written_small(
                marked(found.where("rest IS NOT NULL").select("number", "rest"), split).join(part, "number"), "large-sets")
        roots = components(finer(part, turn))
        again = split.join(roots, split["number"] == roots["node"]).select("number", F.col("root").alias("class"), "n")
        member = written_small(member.join(large, "class", "left_anti").select("number", "class", "n").union(again), "class-members")
    return member


def dealt_sets(found: DataFrame, links: DataFrame, block_shingles: int, finer: FinerLinks | None = None,
               sets: SetsOf | None = None) -> tuple[DataFrame, bool]:
    """The sets of all candidate classes (components of ``links``) in blocks
    of about ``block_shingles`` tokens: (class, block, blocks, number, sketch,
    rest), and whether a class has several.  The sets are those stored in
    ``found`` unless ``sets`` makes them anew."""
    sizes = found.where("number IS NOT NULL").groupBy("number").agg(F.first("n").alias("n"))
    member = written_small(components(links).join(sizes, F.col("node") == F.col("number")).select(
        "number", F.col("root").alias("class"), "n"), "class-members")
    if finer:
        member = finer_classes(found, member, finer, block_shingles, sets)
    parts = member.groupBy("class").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    of_class = parts.where("blocks > 1").select("class", "blocks", salts.alias("__salt"))
    wanted = written_small(
        member.withColumn("__salt", F.pmod(F.xxhash64("number"), F.lit(SALTS)).cast("int"))
        .join(of_class, ["class", "__salt"], "left").select(
            "number", "class", F.coalesce("blocks", F.lit(1)).alias("blocks"),
            F.pmod(F.xxhash64(F.lit(1), "number"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block")), "candidates")
    several = not wanted.where("blocks > 1").isEmpty()
    held = sets(wanted) if sets else marked(found.where("rest IS NOT NULL").select("number", "sketch", "rest"), wanted)
    # A sort-merge join at every size: the number of candidates follows the corpus.
    # Tasks that met the same set each wrote it; one goes on.
    once = held.hint("merge").join(wanted, "number").dropDuplicates(["number"])
    return once.select("class", "block", "blocks", "number", "sketch", "rest"), several


def join_blocks(blocks: DataFrame, block_links: BlockLinks, under: int, over: int, block_shingles: int) -> DataFrame:
    """Links (``a``, ``b``) of all blocks; rows are (class, block, role,
    label, number, sketch, rest).  Any number of sets may ask in a block: they
    come last, and at most ``block_shingles`` tokens of them are held."""

    def run(batches):
        key, members, asking, held, seen = None, [], [], 0, set()

        def links():
            found = block_links(members + asking, under, over)
            columns = list(zip(*found, strict=True)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

        for batch in batches:
            groups, numbers = [c.to_pylist() for c in batch.columns[:4]], batch.column(4).to_pylist()
            sketches, rests = batch.column(5), batch.column(6)
            for i, (label0, block, role, label, number) in enumerate(zip(*groups, numbers, strict=True)):
                if (label0, block) != key:
                    if asking or len(members) > 1:
                        yield links()
                    key, members, asking, held, seen = (label0, block), [], [], 0, set()
                if (number, role) not in seen:
                    seen.add((number, role))
                    low = sketches[i].values.to_numpy().view(np.uint64)
                    tokens = np.concatenate([low, np.frombuffer(rests[i].as_py(), np.uint64)])
                    (asking if role == ASK else members).append((number, label, role, tokens))
                    held += len(tokens) if role == ASK else 0
                    if held >= block_shingles:
                        yield links()
                        asking, held = [], 0
        if asking or len(members) > 1:
            yield links()

    columns = ["class", "block", "role", "label", "number", "sketch", "rest"]
    return (
        blocks.select(*columns).repartition("class", "block").sortWithinPartitions("class", "block", "role")
        .mapInArrow(run, "a long, b long")
    )


def class_links(dealt: DataFrame, several: bool, block_links: BlockLinks, under: int, over: int,
                block_shingles: int) -> DataFrame:
    """Links that join all similar sets of every candidate class.

    Where a class has several blocks, the main members of its blocks are
    joined with each other, then every set outside the largest part visits
    every block: a similar pair that is still apart has such a set."""
    if several:  # its sets are used again below
        dealt = written_small(dealt, "candidate-sets")
    start = dealt.withColumn("role", F.lit(BOTH)).withColumn("label", F.col("number"))
    links = written_small(join_blocks(start, block_links, under, over, block_shingles), "links")
    if not several:
        return links
    split = dealt.where("blocks > 1")

    def labelled(known: DataFrame) -> DataFrame:
        roots = components(known)
        return split.join(roots, split["number"] == roots["node"], "left").withColumn(
            "label", F.coalesce("root", "number")).drop("node", "root")

    # The main member of each block: the smallest set number of its largest part.
    now = labelled(links)
    parts = now.groupBy("class", "block", "label").agg(F.count(F.lit(1)).alias("size"), F.min("number").alias("number"))
    main = parts.groupBy("class", "block").agg(F.max_by("number", F.struct("size", "label")).alias("number"))
    pivots = now.join(main, ["class", "block", "number"]).withColumn("block", F.lit(-1)).withColumn("role", F.lit(BOTH))
    links = written_small(links.union(join_blocks(pivots, block_links, under, over, block_shingles)), "links")
    # What is outside the largest part of a class asks in every block.
    now = written_small(labelled(links), "split-sets")
    largest = now.groupBy("class", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("class").agg(
        F.max_by("label", F.struct("size", "label")).alias("largest"))
    rest = now.join(largest, "class").where("label <> largest").drop("largest").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("role", F.lit(ASK))
    there = now.withColumn("role", F.lit(INSERT))
    asked = there.unionByName(rest.select(*there.columns))
    return written_small(links.union(join_blocks(asked, block_links, under, over, block_shingles)), "links")


def least_ids(found: DataFrame, links: DataFrame) -> DataFrame:
    """(``id``, ``n_shingles``, ``component_id``) of every row: the smallest
    id that the links of its set reach (null ids last); its own id for an
    empty set."""
    rows = found.select("id", F.col("n").cast("long").alias("n_shingles"), "number")
    roots = components(links)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    each = rows.where("number IS NOT NULL").groupBy("number").agg(F.min(order).alias("own"))
    labelled = each.join(roots, F.col("number") == F.col("node"), "left").select(
        "number", "own", F.coalesce("root", "number").alias("root"))
    best = written_small(
        with_least(labelled, ["root"], F.col("own"), "best", F.col("number")).select("number", F.col("best.id").alias("best")),
        "class-ids")
    salted = rows.where("number IS NOT NULL").withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    leaves = salted.select("number", "__salt").distinct().join(best, "number")
    linked = salted.join(leaves, ["number", "__salt"]).select("id", "n_shingles", F.col("best").alias("component_id"))
    return linked.union(rows.where("number IS NULL").select("id", "n_shingles", F.col("id").alias("component_id")))
