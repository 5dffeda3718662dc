"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint_dir

# Characters that separate words in the contracts ([\x20\x09-\x0D]).
BLANKS = " \t\n\x0b\f\r"
# Rows of long texts or large sets go to Python in batches of this size, not of 10,000 rows.
BATCH_LIMIT = {"spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside move Arrow batches of bounded bytes; the session's
    own setting is put back."""
    before = {key: spark.conf.get(key) for key in BATCH_LIMIT}
    for key, value in BATCH_LIMIT.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the
    lineage, and lost executors reread files instead of recomputing.  These
    files stay while a job runs, so they are packed closer than by default."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_small(df: DataFrame, name: str) -> DataFrame:
    """``written``, with Arrow batches of bounded bytes."""
    with small_batches(df.sparkSession):
        return written(df, name)


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts
    as empty text (crc32 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
