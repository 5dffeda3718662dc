"""Typed load, ad-hoc SQL, value normaliser, vector table I/O."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import checkpoint_dir

DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy"]


def parse_date(col: F.Column) -> F.Column:
    """Text date to TIMESTAMP_NTZ or null (never an error under ANSI mode)."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS])


def typed_load(txns: DataFrame, view: str | None = "transactions") -> DataFrame:
    """S3: amount must be a number (strict cast: a bad value fails the job,
    as ``astype(float)`` does), balance number-or-null, ``ts`` parsed from
    the date text or null.  Registers ``view`` for S4."""
    out = txns.withColumn("amount", F.col("amount").cast("double"))
    balance = F.col("balance").cast("string") if "balance" in txns.columns else F.lit(None).cast("string")
    out = out.withColumn("balance", balance.try_cast("double"))
    out = out.withColumn("ts", parse_date(F.col("date").cast("string")))
    if view:
        out.createOrReplaceTempView(view)
    return out


def run_sql(spark: SparkSession, query: str, **args) -> DataFrame:
    """SQL over the registered views, with named parameters (``:name``)."""
    return spark.sql(query, args=args or None)


def _holds_float(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_holds_float(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _holds_float(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _holds_float(dtype.valueType)
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def _without_nan(c: F.Column, dtype: T.DataType) -> F.Column:
    """``c`` with NaN -> null at any depth."""
    if not _holds_float(dtype):
        return c
    if isinstance(dtype, T.StructType):
        fields = [_without_nan(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _without_nan(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: _without_nan(v, dtype.valueType))
    return F.nanvl(c, F.lit(None).cast(dtype))


def sanitize(df: DataFrame) -> DataFrame:
    """NaN -> null in every double/float, also inside structs, arrays and
    maps (a NaN would otherwise poison Spark sums and group together)."""
    return df.select(*[_without_nan(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def save_vectors(df: DataFrame, path: str) -> None:
    """S5 save: the vector table as parquet (overwrite)."""
    df.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """S5 load."""
    return spark.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written_frame(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh scratch folder and read it back.  Its plan then
    knows its true size, so that joins with it are chosen by what it holds."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
