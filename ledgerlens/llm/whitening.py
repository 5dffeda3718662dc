"""Embedding whitening by the leading principal components.

Vectors become integers ``floor(256 x)``; every distinct vector counts once.
The covariance is never formed: its products with a few columns are sums over
blocks of packed vectors, centred before multiplying, one Spark job for all
columns.  The block Jacobi-Davidson method (``jacobi_davidson``) asks for
them until every residual is at double precision.  The driver holds vectors
of one dimension only: sums, a basis of at most 64 columns and the
components.

Defined cases: rows with a null vector or with null or non-finite entries
are dropped; so are vectors of another length than most (of equally common
lengths the longer stays), and empty ones; null and repeated ids are kept as
they are; repeated vectors count once in the fit and each has its rows;
components whose eigenvalue is zero to double precision (fewer distinct
vectors than components, constant dimensions) have no rows, as nothing can
be divided by their deviation; ``deviation`` is null where it leaves 64 bits;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import written
from ledgerlens.llm.jacobi_davidson import EPS, largest_eigenpairs

COMPONENTS = 4
BLOCK_VECTORS = 1024
SCALE = 256.0

_OUT = (
    "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(``vec_id``, ``x``): whole vectors of the most common length."""
    entry = lambda c: c.cast("double")
    whole = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) < float("inf")))
    kept = df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(whole)
    vectors = kept.select(F.col(id_col).alias("vec_id"), F.transform(
        vector_col, lambda c: F.floor(entry(c) * SCALE).cast("long")).alias("x"))
    common = vectors.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("rows")).orderBy(
        F.desc("rows"), F.desc("size")).limit(1).select("size")
    return vectors.join(F.broadcast(common), F.size("x") == F.col("size")).select("vec_id", "x")


def _matrix(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(-1, d)


def packed_blocks(vectors: DataFrame) -> DataFrame:
    """The distinct vectors, up to ``BLOCK_VECTORS`` of them in one binary
    value (``rows``, ``width`` in bytes, ``data``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_VECTORS):
                part = batch.slice(at, BLOCK_VECTORS)
                values = part.column(0).flatten().to_numpy()
                kind = next(t for t in (np.int16, np.int32, np.int64) if t is np.int64 or (
                    np.iinfo(t).min <= values.min() and values.max() <= np.iinfo(t).max))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.num_rows], pa.int32()), pa.array([np.dtype(kind).itemsize], pa.int32()),
                     pa.array([values.astype(kind).tobytes()], pa.binary())], ["rows", "width", "data"])

    distinct = vectors.select("x").distinct()
    return written(distinct.mapInArrow(run, "rows int, width int, data binary"), "whitening-blocks")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for rows, width, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[width]).reshape(rows, -1)


def _summed(blocks: DataFrame, each, size: int) -> np.ndarray:
    """The sum of ``each`` (an array of ``size`` numbers for a block) over all
    blocks: one row per task and number, added by Spark."""

    def run(batches):
        total = np.zeros(size)
        for x in _unpacked(batches):
            total += each(x).reshape(-1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["place", "value"])

    rows = blocks.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[rows["place"].to_numpy()] = rows["value"].to_numpy()
    return out


def exact_sums(blocks: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of every dimension."""

    def run(batches):
        n, totals = 0, None
        for x in _unpacked(batches):
            small = np.abs(x).max(initial=0) < 1 << 40
            own = x.sum(axis=0, dtype=np.int64).tolist() if small else [sum(c) for c in x.T.tolist()]
            n += len(x)
            totals = own if totals is None else [a + b for a, b in zip(totals, own, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(totals)), pa.int32()), pa.array([n, *totals], pa.decimal128(38))], ["place", "value"])

    rows = blocks.mapInArrow(run, "place int, value decimal(38,0)").groupBy("place").agg(F.sum("value").alias("value")).collect()
    found = {r["place"]: int(r["value"]) for r in rows}
    return found.get(-1, 0), [found[k] for k in range(len(found) - 1)]


def principal_components(blocks: DataFrame, n: int, mean: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling) and unit eigenvectors of the covariance, those
    that are not zero, and its trace."""
    d = len(mean)

    def product(columns: np.ndarray) -> np.ndarray:
        def each(x):
            centred = x - mean
            return centred.T @ (centred @ columns)

        return _summed(blocks, each, columns.size).reshape(columns.shape) / n

    trace = float(_summed(blocks, lambda x: np.square(x - mean).sum(), 1)[0]) / n
    if not trace > 0:
        return np.zeros(0), np.zeros((d, 0)), trace
    values, vectors, _ = largest_eigenpairs(product, d, components)
    kept = values > d * 64 * EPS * values[0]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[kept], (vectors * sign)[:, kept], trace


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component."""
    shape = _OUT.format(df.schema[id_col].dataType.simpleString())
    vectors = integer_vectors(df, id_col, vector_col)
    blocks = packed_blocks(vectors)
    n, sums = exact_sums(blocks)
    if not n:
        return df.sparkSession.createDataFrame([], shape)
    mean = np.array([s / n for s in sums])
    values, axes, trace = principal_components(blocks, n, mean, components)
    k, d = len(values), len(sums)
    if not k:
        return df.sparkSession.createDataFrame([], shape)
    axes = axes / np.sqrt(values)  # projection and division at once

    def moments(x):
        z = (x - mean) @ axes
        return np.concatenate([z.sum(axis=0), (z.T @ z).reshape(-1)])

    found = _summed(blocks, moments, k + k * k) / n
    centre, second = found[:k], found[k:].reshape(k, k)
    error = float(np.abs(second - np.outer(centre, centre) - np.eye(k)).max())
    explained = values / trace
    total = np.array(sums, object)
    most_sum = max(map(abs, sums))

    def deviations(x: np.ndarray) -> list[int | None]:
        top = int(np.abs(x).max(initial=0)) * n + most_sum
        if d * top * top < 1 << 63:
            return np.square(x * n - total.astype(np.int64)).sum(axis=1).tolist()
        exact = (np.square(x.astype(object) * n - total)).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, 1, d)
            rows = len(x)
            if not rows:
                continue
            at = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n, np.int64)), pa.array(deviations(x), pa.int64()).take(at),
                pa.array(((x - mean) @ axes).reshape(-1)), pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, shape).withColumnRenamed("vec_id", id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
