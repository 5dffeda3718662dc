"""Exact top-k inner products by aggregation without random access.

Vectors become integers ``floor(256 x)``.  The rows are dealt to blocks of
about ``block_rows``; a block keeps, for each component, its values as a
sorted list.  All queries visit every block.  For a query the lists are
read from the end that scores highest, all to the same depth; what has been
read gives each row a lower bound (unread components count as the smallest
value of their list) and an upper bound (as the value the list has reached).
Reading stops for a query when no more than ``resolve_rows`` rows have an
upper bound that reaches the k-th best lower bound; the final scores of
those rows are then computed.  Reading deeper in steps is done for a batch
of queries at a time as products of matrices.

A block sends at most k rows per query; the best k of all blocks follow in
a window per query, limited before the shuffle.

Defined cases: rows with a null id, a null vector, or null or non-finite
components take no part; vectors are compared only with vectors of the same
length; equal scores rank by smaller id; rows that share the query's id
count as its own row; repeated rows are listed each; extra columns are
ignored; an empty table gives an empty result.  Scores must fit a 64-bit
integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEPS = (8, 4, 2, 1)  # lists are read to these shares of their length
QUERY_BATCH = 256


class SortedLists:
    """The rows of a block with a sorted list per component."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[by_id], values[by_id]
        self.lists = np.sort(self.values, axis=0)  # ascending values of each component

    def bounds(self, depth: int) -> tuple[np.ndarray, ...]:
        """Bounds of every value once each list is read ``depth`` deep from
        its top (for positive weights) and from its bottom (for negative)."""
        x, n = self.values, len(self.values)
        low, high = self.lists[0], self.lists[-1]
        top, bottom = self.lists[n - depth], self.lists[depth - 1]
        return (np.where(x >= top, x, low), np.maximum(x, top), np.where(x <= bottom, x, high), np.minimum(x, bottom))

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int, resolve_rows: int):
        """(query, id, score) of the k best rows of each query."""
        n = len(self.ids)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        active = np.arange(len(queries))
        for share in STEPS:
            depth = n if share == 1 else max(1, n // share)
            lo_up, hi_up, lo_down, hi_down = self.bounds(depth)
            lower = up[active] @ lo_up.T + down[active] @ lo_down.T
            upper = up[active] @ hi_up.T + down[active] @ hi_down.T
            own = query_ids[active][:, None] == self.ids[None, :]
            floor = lower.min() - 1
            lower[own] = floor
            if n > k:
                bar = np.partition(lower, n - k, axis=1)[:, n - k]
            else:
                bar = np.full(len(active), floor)
            qualify = (upper >= bar[:, None]) & ~own
            settled = (qualify.sum(1) <= resolve_rows) | (depth == n)
            for row in np.flatnonzero(settled).tolist():
                i = active[row]
                rows = np.flatnonzero(qualify[row])
                scores = self.values[rows] @ queries[i]
                for j in np.lexsort((self.ids[rows], -scores))[:k].tolist():
                    yield int(query_ids[i]), int(self.ids[rows[j]]), int(scores[j])
            active = active[~settled]
            if not len(active):
                return


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5,
          block_rows: int = 4096, resolve_rows: int = 64) -> DataFrame:
    """``query_id``, ``rank``, the id, ``score`` for the k best rows of each
    row where ``is_query`` holds, among all other rows."""
    rows = df.where(F.col(id_col).isNotNull() & F.coalesce(usable(F.col(vector_col)), F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec"), is_query.alias("asks"),
        F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"),
    ).withColumn("dim", F.size("v"))
    blocks = max(1, -(-df.count() // block_rows))
    block = F.pmod(F.xxhash64("vec"), F.lit(blocks)).cast("int")
    corpus = rows.select("dim", block.alias("block"), F.lit(0).alias("kind"), "vec", "v")
    # The stated query set against all rows, in blocks.
    queries = rows.where("asks").select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, lists, asked = None, [], [], None, []

        def matrix(vs):
            whole = np.array(vs, np.int64).reshape(len(vs), -1)
            return whole

        def answer():
            nonlocal lists, ids, vectors, asked
            if lists is None and ids:
                lists = SortedLists(np.array(ids, np.int64), matrix(vectors))
                ids, vectors = [], []
            found = []
            if lists is not None and asked:
                q = matrix([v for _, v in asked])
                limit = (int(np.abs(q).max(initial=0)) or 1) * (int(np.abs(lists.values).max(initial=0)) or 1) * max(1, q.shape[1])
                kind = np.float64 if limit < 1 << 52 else np.int64  # floats are exact up to 2**53
                exact = lists if lists.values.dtype == kind else SortedLists(lists.ids, lists.values.astype(kind))
                found = list(exact.best(np.array([i for i, _ in asked]), q.astype(kind), k, resolve_rows))
                lists = exact
            asked = []
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec", "score"])

        for batch in batches:
            for dim, blk, kind, vec, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (dim, blk) != key:
                    if asked:
                        yield answer()
                    key, ids, vectors, lists = (dim, blk), [], [], None
                if kind == 0:
                    ids.append(vec)
                    vectors.append(v)
                else:
                    asked.append((vec, v))
                    if len(asked) == QUERY_BATCH:
                        yield answer()
        if asked:
            yield answer()

    near = (
        corpus.unionByName(queries)
        .repartition(blocks, "dim", "block")
        .sortWithinPartitions("dim", "block", "kind", "vec")
        .select("dim", "block", "kind", "vec", "v")
        .mapInArrow(search, "query_id long, vec long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec"))
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("vec").alias(id_col), "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(embeddings, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([a[1] * a[2] FOR a IN list_zip(q.e, c.e)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""
