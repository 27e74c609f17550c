"""Arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """Division of doubles as IEEE 754 has it: x/0 is an infinity, 0/0 and NaN are NaN, null stays null."""
    x, y = a.cast("double"), b.cast("double")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when((y == 0) & ((x == 0) | F.isnan(x)), nan).when(y == 0, F.signum(x) * inf).otherwise(F.try_divide(x, y))


def add(a: Column, b: Column, text: bool = False) -> Column:
    """Sum, or concatenation where the column holds text."""
    return F.concat(a, b) if text else a + b


def row_hash(*cols: Column | str) -> Column:
    """A 64-bit hash of a row's values."""
    return F.xxhash64(*cols)
