"""Skew-safe ordered computations: running totals and previous-row look-ups.

A window ``partitionBy(statement_id).orderBy(ts)`` sorts every row of a
statement into one task; a statement holding a third of the data would
then be one task holding a third of the data.  The helpers here split the
order into buckets that are monotone in it (a day of ``ts``), and work in
two levels:

1. inside each ``(key, bucket)`` an ordinary window (bounded by one
   bucket's rows);
2. across buckets, a window over the *bucket table* (one row per
   ``(key, bucket)``, so small) that carries the totals / last row of the
   earlier buckets, joined back on ``(key, bucket)``.

Both levels are exact: bucket totals are sums of integers/decimals.

The rows are shuffled once, by (keys, bucket), for the first-level
window.  The bucket table comes from a partial (map-side) aggregation, so
only one row per bucket and task crosses the network for it, and the join
back is a plain equi-join on non-null stand-ins of the keys: the big side
keeps the window's hash partitioning and only the small bucket table
moves.  (A null-safe join would be rewritten to other key expressions and
shuffle every row a second time.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BUCKET = "__bucket"


def day_bucket(ts: Column | str) -> Column:
    """Day of ``ts``; a null day becomes 0001-01-01, which sorts before every
    real day, as nulls do."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.coalesce(F.to_date(ts), F.lit("0001-01-01").cast("date"))


def _stand_in(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.coalesce(c, F.lit(""))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(c, F.lit(0).cast(dtype))
    return F.coalesce(c.cast("string"), F.lit(""))


def _with_groups(df: DataFrame, keys: Sequence[str], bucket: Column) -> tuple[DataFrame, list[str], list[str]]:
    """Add the bucket and, per key, a non-null value + null flag that are
    equal exactly when the keys are equal null-safely.  Returns the frame,
    the key stand-ins, and the stand-ins plus the bucket."""
    extra, names = [], []
    for i, k in enumerate(keys):
        dtype = df.schema[k].dataType
        extra += [_stand_in(F.col(k), dtype).alias(f"__gk{i}"), F.col(k).isNull().alias(f"__gn{i}")]
        names += [f"__gk{i}", f"__gn{i}"]
    return df.select("*", *extra, bucket.alias(_BUCKET)), names, [*names, _BUCKET]


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    values: dict[str, Column],
) -> DataFrame:
    """Add inclusive running sums ``values`` ordered by ``order`` per ``keys``.

    ``bucket`` must be monotone in ``order`` (all rows of an earlier bucket
    sort before all rows of a later one) and never null.
    """
    tmp, gkeys, groups = _with_groups(df, keys, bucket)
    bucket_totals = tmp.groupBy(*groups).agg(
        *[F.sum(expr).alias(f"__t_{name}") for name, expr in values.items()]
    )
    earlier = Window.partitionBy(*gkeys).orderBy(F.col(_BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucket_totals.select(
        *groups,
        *[F.coalesce(F.sum(f"__t_{name}").over(earlier), F.lit(0)).alias(f"__o_{name}") for name in values],
    )
    inside = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = tmp.select("*", *[F.sum(expr).over(inside).alias(f"__l_{name}") for name, expr in values.items()])
    joined = local.join(offsets, groups, "inner")
    return joined.select(
        *df.columns,
        *[(F.col(f"__l_{n}") + F.col(f"__o_{n}")).alias(n) for n in values],
    )


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    columns: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """Add ``prefix + c`` = value of ``c`` on the previous row in ``order``
    within ``keys`` (null on the first row), i.e. ``lag(c)`` without
    putting a whole key into one task.  Same bucket rule as above."""
    tmp, gkeys, groups = _with_groups(df, keys, bucket)
    inside = Window.partitionBy(*groups).orderBy(*order)
    local = tmp.select(
        "*",
        F.lag(F.lit(True)).over(inside).isNull().alias("__first"),
        *[F.lag(c).over(inside).alias(f"__p_{c}") for c in columns],
    )
    order_struct = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    last = tmp.groupBy(*groups).agg(
        F.max_by(F.struct(*[F.col(c) for c in columns]), order_struct).alias("__last")
    )
    prev_bucket = last.select(
        *groups,
        F.lag("__last").over(Window.partitionBy(*gkeys).orderBy(F.col(_BUCKET))).alias("__pb"),
    )
    joined = local.join(prev_bucket, groups, "inner")
    return joined.select(
        *df.columns,
        *[
            F.when(F.col("__first"), F.col("__pb")[c]).otherwise(F.col(f"__p_{c}")).alias(prefix + c)
            for c in columns
        ],
    )
