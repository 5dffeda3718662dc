"""Money as exact scaled integers.

Sums of doubles depend on the order in which partitions are added, so a
result computed on 8 threads and on 1000 executors could differ in the
last bit.  Every money aggregate here is a sum of BIGINT millionths of a
dollar (so parts of a cent count), turned into a double by one division at
the end; results that the reference rounds are rounded once, after the sum.
A NaN or infinite amount counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = 1_000_000  # units of a dollar
_PER_CENT = UNITS // 100


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def units(amount: Column | str) -> Column:
    """Millionths of a dollar; null for a missing, NaN or infinite amount."""
    return F.round(_c(amount) * UNITS).try_cast("bigint")


def dollars(units_col: Column | str) -> Column:
    """The exact amount as a double (one division)."""
    return _c(units_col).cast("double") / F.lit(float(UNITS))


def int_div(a: Column, b: Column) -> Column:
    """Exact integer division (truncates toward zero)."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def _half_up(value: Column, divisor: Column) -> Column:
    """``value / divisor`` to a whole number, halves away from zero, in
    integers."""
    up = int_div(F.abs(value) * 2 + divisor, divisor * 2)
    return F.when(value < 0, -up).otherwise(up)


def rounded(units_col: Column | str) -> Column:
    """Dollars rounded to whole cents, once."""
    return _half_up(_c(units_col), F.lit(_PER_CENT)).cast("double") / F.lit(100.0)


def rounded_mean(sum_units: Column, count: Column) -> Column:
    """The mean in dollars, rounded to whole cents, once."""
    return _half_up(sum_units, count * _PER_CENT).cast("double") / F.lit(100.0)


def money_text(x: Column | str) -> Column:
    """``$1,234.56`` / ``$-49.99``: ``format_number`` rounds the exact
    binary value, as Python's ``format(x, ',.2f')`` does."""
    return F.concat(F.lit("$"), F.format_number(_c(x), 2))
