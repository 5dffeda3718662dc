"""Prefix trie of conversations by burst tries.

Every distinct sequence of first turns is a node.  Turns are (role, text),
known by a 128-bit digest; conversations of equal turns are one sequence with
a weight, so copies never meet again.

1. *Bursting.*  All sequences start in one container below the root.  A
   container of more than ``container_turns`` turns bursts by next turn id:
   its sequences move to the containers of the next heads, a window of
   ``BURST_LEVELS`` levels a round, so that a round's work is the turns of
   that window only.  Sizes are partial aggregates; the few oversized heads
   are joined back.
2. *Sweep.*  What is left of a container's sequences, at most
   ``container_turns`` turns, is sorted by path; one pass with a stack of open
   nodes closes a node when the path leaves it.  Containers of all shards
   stream through the sorted partitions, one container in memory.  A single
   sequence that is longer than a container shares nothing any more: each of
   its turns is a node by itself, computed row by row.
3. *Upper nodes.*  Nodes above the containers add up, per head, what their
   members own: a node is owned by the smallest of its conversations, which
   then owns all nodes below on its path, so every node is counted once.

The list of conversations that end in a node is digested as a stream of
sorted pieces: a node that holds a third of all conversations is many range
partitions of ids, then a few long rows.

Defined cases: null role or text counts as empty; rows with a null conv_id
belong to no conversation; equal turn numbers are ordered by turn digest; a
repeated row is a turn of its own; a conversation without turns is a member
of the root only; extra columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.windows import running_totals
from ledgerlens.llm.common import written

CONTAINER_TURNS = 2048
BURST_LEVELS = (8, 64, 256)  # levels of the first rounds; the last holds for all others
ID_BYTES = 16
PIECE_IDS = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = b""

_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)
_NODE_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


def turn_table(conversations: DataFrame) -> DataFrame:
    """(``conv_id``, ``pos`` from 1, ``turn_id``, ``chars``) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat_ws("\n", F.length(role).cast("string"), role, text).cast("binary"))).alias("turn_id"),
        F.char_length(text).cast("long").alias("chars"))
    # Turns in buckets of 256: a conversation of any length is many groups.
    bucket = F.coalesce(F.shiftright("turn", 8), F.lit(-(1 << 62)))
    order = [F.col("turn").asc_nulls_first(), F.col("turn_id")]
    return running_totals(turns, ["conv_id"], bucket, order, {"pos": F.lit(1).cast("long")}).drop("turn")


def rebuilt_turns(turns: DataFrame, shared: Column, base: Column, most: int) -> DataFrame:
    """Turns of rebuilt conversations: the first ``shared`` turns (at most
    ``most``) of conversation ``base``, then the own turns after as many."""
    ids = turns.select("conv_id").distinct().select("conv_id", shared.alias("shared"), base.alias("base"))
    bases = turns.where(F.col("pos") <= most).where(F.col("conv_id") == base)
    had = bases.groupBy(F.col("conv_id").alias("base")).agg(F.max("pos").alias("had"))
    taken = ids.join(bases.withColumnRenamed("conv_id", "base"), "base").where("pos <= shared").select(
        "conv_id", "pos", "turn_id", "chars")
    kept = ids.join(had, "base", "left").select(
        "conv_id", "shared", F.least("shared", F.coalesce("had", F.lit(0))).alias("taken"))
    own = turns.join(kept, "conv_id").where("pos > shared").select(
        "conv_id", (F.col("pos") - F.col("shared") + F.col("taken")).alias("pos"), "turn_id", "chars")
    return taken.unionByName(own)


def _ends(members: DataFrame) -> DataFrame:
    """(``rep``, ``ends``): the digest of each sequence's ids (``rep``,
    ``conv_id``), ascending and joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now, held = [], None, []
        for batch in batches:
            for rep, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rep != now or len(held) >= PIECE_IDS:
                    if held:
                        rows.append((now, held[0], ",".join(map(str, held))))
                    now, held = rep, []
                held.append(conv)
                if len(rows) >= 256:
                    yield _batch(rows, ("rep", "first", "ids"))
                    rows = []
        if held:
            rows.append((now, held[0], ",".join(map(str, held))))
        if rows:
            yield _batch(rows, ("rep", "first", "ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rows = None, None, []
        for batch in batches:
            for rep, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or rep != now:
                    if state is not None:
                        rows.append((now, state.hexdigest()))
                    now, state = rep, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if rows:
                yield _batch(rows, ("rep", "ends"))
                rows = []
        if state is not None:
            yield _batch([(now, state.hexdigest())], ("rep", "ends"))

    cut = members.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(
        pieces, "rep long, first long, ids string")
    return cut.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(digests, "rep long, ends string")


def _batch(rows: list[tuple], names: tuple[str, ...] | list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))


def _sequences(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """Distinct sequences: ``rep`` (smallest id), ``turns`` (their number),
    ``weight`` and ``ends``.  Positions differ within a conversation, so the
    exclusive or of its (position, turn) hashes stands for the sequence."""
    prints = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.bit_xor(F.xxhash64("pos", "turn_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "turn_id", "pos")).alias("y"))
    whole = ids.join(prints, "conv_id", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("turns", "x", "y")])
    whole = written(whole, "trie-prints")
    reps = whole.groupBy("turns", "x", "y").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    repeated = reps.where("weight > 1").select("turns", "x", "y", "rep")
    ends = _ends(whole.join(repeated, ["turns", "x", "y"]).select("rep", "conv_id"))
    alone = F.sha2(F.col("rep").cast("string").cast("binary"), 256)
    return written(
        reps.join(ends, "rep", "left").select("rep", "turns", "weight", F.coalesce("ends", alone).alias("ends")),
        "trie-sequences")


def _burst(turns: DataFrame, reps: DataFrame, container_turns: int) -> tuple[DataFrame, DataFrame]:
    """Upper rows (``conv_id``, ``pos``, ``head``, ``parent``, ``chars``) and
    entries (``conv_id``, ``start``, ``head``, ``parent``, ``long``): where a
    sequence enters its container; ``long`` marks a single sequence that is
    longer than a container."""
    upper = entries = None
    active = reps.where("turns > 0").select("conv_id", "turns", F.lit(ROOT).alias("head"))
    low, round_no = 0, 0
    while True:
        high = low + BURST_LEVELS[min(round_no, len(BURST_LEVELS) - 1)]
        window = turns.where(F.col("pos").between(low + 1, high))
        paths = active.join(window, "conv_id").groupBy("conv_id", "turns", "head").agg(
            F.array_sort(F.collect_list(F.struct("pos", "turn_id", "chars"))).alias("steps"))
        hexes = F.transform("steps", lambda s: F.hex(s["turn_id"]))
        heads = F.transform(F.sequence(F.lit(1), F.size("steps")), lambda i: F.unhex(F.md5(F.concat(
            F.hex("head"), F.array_join(F.slice("__hex", F.lit(1), i), "")).cast("binary"))))
        levels = paths.withColumn("__hex", hexes).withColumn("heads", heads).select(
            "conv_id", "turns", F.posexplode(F.arrays_zip(
                F.col("steps.pos").alias("pos"), F.col("steps.chars").alias("chars"), F.col("heads").alias("to"),
                F.concat(F.array("head"), F.slice("heads", F.lit(1), F.size("heads") - 1)).alias("parent"))).alias("i", "s"),
        ).select("conv_id", "turns", "s.pos", "s.chars", F.col("s.to").alias("head"), "s.parent")
        levels = written(levels, "trie-levels")
        oversized = levels.groupBy("head").agg(
            F.count(F.lit(1)).alias("members"), F.sum(F.col("turns") - F.col("pos") + 1).alias("held"),
        ).where(F.col("held") > container_turns).select("head", "members")
        marked = written(levels.join(oversized, "head", "left"), "trie-marked")
        bursting = marked.where("members > 1")
        own = bursting.select("conv_id", "pos", "head", "parent", "chars")
        first = marked.where("members IS NULL OR members = 1").groupBy("conv_id").agg(
            F.min("pos").alias("start"),
            F.min_by(F.struct("head", "parent", F.col("members").isNotNull().alias("long")), "pos").alias("at"),
        ).select("conv_id", "start", "at.*")
        upper = own if upper is None else upper.unionByName(own)
        entries = first if entries is None else entries.unionByName(first)
        active = bursting.where((F.col("pos") == high) & (F.col("turns") > high)).select("conv_id", "turns", "head")
        if active.isEmpty():
            return upper, entries
        low, round_no = high, round_no + 1


def sweep(rows: list[tuple]) -> list[list]:
    """The nodes of one container: ``rows`` (path, chars, start, conv_id,
    weight, ends) sorted by path, whose first turns agree."""
    done: list[list] = []
    parents: list[int] = []
    open_nodes: list[int] = []  # places in ``done`` along the current path

    def close() -> None:
        at = open_nodes.pop()
        node = done[at]
        node[5] = node[5] or 1  # a childless node is its own leaf
        node[6] += (node[3] - 1) * node[8]
        if open_nodes:
            parents[at] = open_nodes[-1]
            above = done[open_nodes[-1]]
            above[0] = node[0] if above[0] is None else min(above[0], node[0])
            above[3] += node[3]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]

    before = b""
    for path, chars, start, conv, weight, ends in rows:
        most, same = min(len(path), len(before)), 0
        while same < most and path[same : same + ID_BYTES] == before[same : same + ID_BYTES]:
            same += ID_BYTES
        same //= ID_BYTES
        while len(open_nodes) > same:
            close()
        for k in range(same, len(path) // ID_BYTES):
            open_nodes.append(len(done))
            done.append([None, start + k, None, 0, 0, 0, 0, NO_ENDS, chars[k]])
            parents.append(-1)
        last = done[open_nodes[-1]]
        last[0] = conv if last[0] is None else min(last[0], conv)
        last[3] += weight
        last[7] = ends
        before = path
    while open_nodes:
        close()
    for node, parent in zip(done, parents, strict=True):
        if parent >= 0:
            node[2] = done[parent][0]
    return done


def _sweep_containers(turns: DataFrame, entries: DataFrame, reps: DataFrame) -> DataFrame:
    """Nodes of all containers; ``parent`` is the head above a container's
    first node, null for the others."""
    rest = turns.join(entries.where("NOT long"), "conv_id").where("pos >= start").groupBy("conv_id", "head", "parent", "start").agg(
        F.array_sort(F.collect_list(F.struct("pos", "turn_id", "chars"))).alias("steps"))
    path = F.unhex(F.array_join(F.transform("steps", lambda s: F.hex(s["turn_id"])), ""))
    suffixes = rest.join(reps, "conv_id").select(
        "head", path.alias("path"), F.col("steps.chars").alias("chars"), "start", "conv_id", "weight", "ends", "parent")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, above, held, out = None, None, [], []

        def finish():
            nodes = sweep(held)
            out.extend((*node[:8], above if node[2] is None else None) for node in nodes)

        def emit():
            kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, [*_NODE_COLUMNS, "parent"])

        for batch in batches:
            for head, *row, parent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if head != now:
                    if held:
                        finish()
                        if len(out) >= 8192:
                            yield emit()
                            out = []
                    now, above, held = head, parent, []
                held.append(tuple(row))
        if held:
            finish()
        if out:
            yield emit()

    return suffixes.repartition("head").sortWithinPartitions("head", "path").mapInArrow(run, _NODE + ", parent binary")


def _long_tails(turns: DataFrame, entries: DataFrame, reps: DataFrame) -> DataFrame:
    """Nodes of single sequences longer than a container, one per turn."""
    alone = entries.where("long").join(reps, "conv_id")
    rows = turns.join(alone, "conv_id").where("pos >= start").withColumn("saves", (F.col("weight") - 1) * F.col("chars"))
    down = running_totals(rows, ["conv_id"], -F.shiftright("pos", 8), [F.col("pos").desc()], {"saved": F.col("saves")})
    first, last = F.col("pos") == F.col("start"), F.col("pos") == F.col("turns")
    return down.select(
        "conv_id", F.col("pos").alias("depth"), F.when(~first, F.col("conv_id")).alias("parent_conv_id"),
        F.col("weight").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(NO_ENDS).alias("ends_sha256"), F.when(first, F.col("parent")).alias("parent"))


def trie_nodes(ids: DataFrame, turns: DataFrame, *, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """The nodes of the trie of all conversations: ``ids`` (``conv_id``, those
    without turns too) and ``turns`` (``conv_id``, ``pos`` from 1 without
    gaps, ``turn_id`` of 16 bytes, ``chars``)."""
    reps = _sequences(ids, turns).withColumnRenamed("rep", "conv_id")
    own = written(turns.join(reps.select("conv_id"), "conv_id", "left_semi"), "trie-turns")
    above, entries = _burst(own, reps, container_turns)
    entries = written(entries, "trie-entries")
    below = written(
        _sweep_containers(own, entries, reps).unionByName(_long_tails(own, entries, reps)), "trie-below")
    tops = below.where("parent IS NOT NULL")

    # Every sequence is a member of the root and of the heads on its way.
    root = reps.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(ROOT).alias("head"),
                       F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"))
    rows = above.unionByName(root).join(reps, "conv_id")
    heads = written(
        rows.groupBy("head").agg(
            F.min("conv_id").alias("owner"), F.sum("weight").alias("n_convs"), F.first("pos").alias("depth"),
            F.first("parent").alias("parent"), F.first("chars").alias("chars"),
            F.max(F.when(F.col("turns") == F.col("pos"), F.col("ends"))).alias("ends")), "trie-heads")
    children = heads.where("parent IS NOT NULL").select("parent").union(tops.select("parent")).groupBy(
        F.col("parent").alias("head")).agg(F.count(F.lit(1)).alias("n_children"))
    # What a sequence owns: one value per upper node, one for all that is below.
    owned = heads.select(F.col("owner").alias("conv_id"), F.col("depth").alias("pos"),
                         ((F.col("n_convs") - 1) * F.col("chars")).alias("saves"))
    under = tops.groupBy("conv_id").agg(F.sum("n_leaves").alias("leaves_below"), F.sum("saved_tokens").alias("saved_below"))
    downward = running_totals(
        rows.select("conv_id", "pos", "head").join(owned, ["conv_id", "pos"], "left"), ["conv_id"],
        -F.shiftright("pos", 8), [F.col("pos").desc()], {"saved": F.coalesce("saves", F.lit(0))})
    sums = downward.join(under, "conv_id", "left").groupBy("head").agg(
        F.sum(F.col("saved") + F.coalesce("saved_below", F.lit(0))).alias("saved_tokens"),
        F.sum(F.coalesce("leaves_below", F.lit(0))).alias("n_leaves"))
    owner_of = heads.select(F.col("head").alias("parent"), F.col("owner").alias("parent_owner"))
    upper = heads.join(sums, "head").join(children, "head", "left").join(owner_of, "parent", "left").select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent_owner").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
        "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
    first = tops.drop("parent_conv_id").join(owner_of, "parent").withColumnRenamed("parent_owner", "parent_conv_id")
    return upper.unionByName(first.select(*_NODE_COLUMNS)).unionByName(
        below.where("parent IS NULL").select(*_NODE_COLUMNS))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of a conversations table as it is."""
    turns = written(turn_table(conversations), "trie-input")
    return trie_nodes(turns.select("conv_id").distinct(), turns)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(turn_table(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-input")
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    base = F.col("conv_id") - F.col("conv_id") % 100
    rebuilt = written(rebuilt_turns(turns, shared, base, 5), "trie-rebuilt")
    return trie_nodes(turns.select("conv_id").distinct(), rebuilt)


SQL = """
WITH crc AS (
  SELECT conv_id, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                               lambda p, q: xor(p >> 1, (p & 1) * 3988292384::BIGINT))) AS raw
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
conv AS (SELECT conv_id, xor(raw, 4294967295::BIGINT) % 6 AS h, conv_id - conv_id % 100 AS base FROM crc),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         md5(coalesce(role, '')) || md5(coalesce(text, '')) AS tid, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT c.conv_id, t.pos AS place, 0 AS own, t.tid, t.chars FROM conv c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos, 1, t.tid, t.chars FROM conv c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
placed AS (
  SELECT conv_id, tid, chars, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth FROM rebuilt),
paths AS (
  SELECT conv_id, depth, chars, md5(string_agg(tid, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key,
         depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM placed
  UNION ALL
  SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM placed) FROM conv),
nodes AS (
  SELECT key, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY key),
linked AS (
  SELECT n.*, p.key AS parent_key, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN paths q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1 LEFT JOIN nodes p ON p.key = q.key),
kids AS (SELECT parent_key AS key, count(*) AS n_children FROM linked WHERE parent_key IS NOT NULL GROUP BY 1),
below AS (
  SELECT up.key, sum(CASE WHEN k.key IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
  FROM nodes n LEFT JOIN kids k ON k.key = n.key JOIN paths up ON up.conv_id = n.conv_id AND up.depth <= n.depth
  GROUP BY up.key)
SELECT l.conv_id, l.depth, l.parent_conv_id, l.n_convs, coalesce(k.n_children, 0) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, l.ends_sha256
FROM linked l LEFT JOIN kids k ON k.key = l.key JOIN below b ON b.key = l.key
"""
