"""User functions, always in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridframe.functions.types import resolve_type
from gridframe.operators.columns import Key, col, names_of

#: The type of a column by the kinds of values that are in it.
_KINDS = {(): T.StringType(), ("bool",): T.BooleanType(), ("int",): T.LongType(), ("float",): T.DoubleType(), ("float", "int"): T.DoubleType(), ("str",): T.StringType(), ("bytes",): T.BinaryType()}


def _kinds_of(values: pd.Series) -> list[str]:
    """The kinds of a batch's results; nulls have none."""
    types = {type(v.item() if hasattr(v, "item") else v) for v in values.dropna()}
    return sorted({next((k.__name__ for k in (bool, int, float, str, bytes) if issubclass(t, k)), t.__name__) for t in types})


def infer_types(df: DataFrame, fn: Callable[[pd.Series], pd.Series]) -> dict[str, T.DataType]:
    """The type of ``fn`` of every column, over all rows: long where all results are whole numbers, double where some are not, string where all are null; TypeError for a mixture of other kinds."""

    def run(batches):
        for pdf in batches:
            found = [(c, k) for c in pdf.columns for k in _kinds_of(pd.Series(fn(pdf[c])))]
            yield pd.DataFrame({"column": [c for c, _ in found], "kind": [k for _, k in found]}, dtype=object)

    kinds: dict[str, list[str]] = {c: [] for c in df.columns}
    for r in df.mapInPandas(run, "column string, kind string").distinct().collect():  # a few rows a column
        kinds[r["column"]].append(r["kind"])
    wrong = {c: k for c, k in kinds.items() if tuple(sorted(k)) not in _KINDS}
    if wrong:
        raise TypeError(f"results have no common type, give dtype: {wrong}")
    return {c: _KINDS[tuple(sorted(k))] for c, k in kinds.items()}


def infer_map(df: DataFrame, fn: Callable[[pd.Series], pd.Series], dtype=None) -> DataFrame:
    """``fn`` of every column as a whole (a batch at a time). Without ``dtype`` a pass over all rows finds the types, at once."""
    kinds = infer_types(df, fn) if dtype is None else dict.fromkeys(df.columns, resolve_type(dtype))

    def one(c: str):
        wrapped = F.pandas_udf(lambda s: pd.Series(fn(s)), kinds[c])
        return wrapped(col(c)).alias(c)

    return df.select(*[one(c) for c in df.columns])


def apply_map(df: DataFrame, fn: Callable, dtype=None) -> DataFrame:
    """``fn`` of every cell, called for one cell at a time since it is a function of a scalar; nulls are passed as None. ``infer_map`` takes functions of whole batches."""
    return infer_map(df, lambda s: s.astype(object).where(s.notna(), None).map(fn), dtype)


def apply_groups(df: DataFrame, keys: Key | list[Key], fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """``fn`` of each group as a pandas DataFrame: a group must fit in a task's memory."""
    return df.groupBy(*[col(k) for k in names_of(df, keys)]).applyInPandas(fn, schema)


def pipe(df: DataFrame, fn: Callable, *args, **kwargs):
    """``fn(df, ...)``."""
    return fn(df, *args, **kwargs)


def aggregate_udf(df: DataFrame, keys: Key | list[Key], value: Key, fn: Callable[[pd.Series], object], dtype, name: str) -> DataFrame:
    """A user's aggregate of a column by group; the group's column must fit in a task's memory."""
    udaf = _series_to_scalar(fn, resolve_type(dtype))
    return df.groupBy(*[col(k) for k in names_of(df, keys)]).agg(udaf(col(names_of(df, value)[0])).alias(name))


def _series_to_scalar(fn: Callable, kind: T.DataType):
    import typing

    def wrapped(s):
        return fn(s)

    wrapped.__annotations__ = {"s": pd.Series, "return": typing.Any}
    return F.pandas_udf(wrapped, kind)
