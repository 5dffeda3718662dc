"""Reading the parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan one table; naming columns here keeps the parquet ReadSchema narrow
    even before Catalyst's own pruning sees the rest of the plan."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Give CPU-heavy per-row work (regex passes, text folds) all cores.

    ``scan`` must be a plain table scan: its split count is known from the
    file listing without running anything.  A large table already has far
    more splits than cores and is returned as it is (no shuffle); a table
    stored as a few big row groups would otherwise run its text work in a
    few tasks, so it is hash-partitioned by ``key`` over the cluster's
    default parallelism (deterministic, so a lost task recomputes the same
    rows)."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)
