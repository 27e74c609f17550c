"""Projection, filters, predicates, nulls and casts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridframe.functions import scalar
from gridframe.functions.types import class_of, resolve_type
from gridframe.operators.columns import Key, col, names_of, numbered


def project(df: DataFrame, columns: Key | Sequence[Key]) -> DataFrame:
    """Columns by name or position, in the order given; a position may point at a repeated name."""
    keys = [columns] if isinstance(columns, (str, int)) else list(columns)
    if len(set(df.columns)) == len(df.columns):
        return df.select(*[col(c) for c in names_of(df, keys)])
    at = [k if isinstance(k, int) else df.columns.index(k) for k in keys]
    return numbered(df).select(*[f"c{i}" for i in at]).toDF(*[df.columns[i] for i in at])


def select(df: DataFrame, predicate: Column | str | Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Rows for which the predicate holds; null counts as false.

    A Column or SQL text reaches the scan.  A Python function gets a pandas DataFrame of a batch and returns a boolean
    Series: it runs in Arrow batches, never row by row, but hides the predicate from the optimizer.
    """
    if isinstance(predicate, (Column, str)):
        return df.filter(predicate)

    def run(batches):
        for pdf in batches:
            yield pdf[pd.Series(predicate(pdf), index=pdf.index).fillna(False).astype(bool)]

    return df.mapInPandas(run, df.schema)


def select_rows(df: DataFrame, predicate: Callable[[dict], bool]) -> DataFrame:
    """Rows for which a function of one row, given as a dict, is true: a Python call a row, for predicates that know no vectors; ``select`` takes those that do."""
    return select(df, lambda pdf: pd.Series([bool(predicate(r)) for r in pdf.to_dict("records")], index=pdf.index, dtype=bool))


def drop(df: DataFrame, columns: Key | Sequence[Key]) -> DataFrame:
    """Without the columns; KeyError for unknown ones."""
    gone = set(names_of(df, columns))
    return df.select(*[col(c) for c in df.columns if c not in gone])


def rename(df: DataFrame, to: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """New names, by a mapping (ValueError for unknown names) or for all columns in order (ValueError for another number)."""
    if isinstance(to, Mapping):
        if missing := set(to) - set(df.columns):
            raise ValueError(f"unknown columns {sorted(missing)}")
        return df.toDF(*[to.get(c, c) for c in df.columns])
    if len(to) != len(df.columns):
        raise ValueError(f"{len(to)} names for {len(df.columns)} columns")
    return df.toDF(*to)


def add_prefix(df: DataFrame, text: str) -> DataFrame:
    """``text`` before every column's name; cells stay as they are."""
    return df.toDF(*[text + c for c in df.columns])


def add_suffix(df: DataFrame, text: str) -> DataFrame:
    """``text`` after every column's name; cells stay as they are."""
    return df.toDF(*[c + text for c in df.columns])


def add_column(df: DataFrame, position: int, name: str, value: Column) -> DataFrame:
    """A column computed from the others, inserted at ``position``."""
    if not 0 <= position <= len(df.columns):
        raise IndexError(f"position {position} of {len(df.columns)} columns")
    cols = [col(c) for c in df.columns]
    return df.select(*cols[:position], value.alias(name), *cols[position:])


def select_dtypes(df: DataFrame, include=None, exclude=None) -> DataFrame:
    """Columns by class of type (``number``, ``int64``, ``object`` ...); ValueError if none is given or both overlap."""
    listed = lambda x: set() if x is None else {x if isinstance(x, str) else getattr(x, "__name__", str(x)) for x in ([x] if isinstance(x, (str, type)) else x)}
    take, leave = listed(include), listed(exclude)
    if not take and not leave:
        raise ValueError("neither include nor exclude is given")
    if take & leave:
        raise ValueError(f"include and exclude overlap: {sorted(take & leave)}")
    return df.select(*[col(f.name) for f in df.schema if (not take or class_of(f.dataType) & take) and not class_of(f.dataType) & leave])


def each(df: DataFrame, fn: Callable[[Column, T.DataType], Column]) -> DataFrame:
    """``fn`` of every column, names kept."""
    return df.select(*[fn(col(f.name), f.dataType).alias(f.name) for f in df.schema])


_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
_MATH = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": scalar.divide}


def _operand(value, kind: T.DataType) -> Column:
    """A Column as it is; a value as a literal, of the column's type where that loses nothing."""
    if isinstance(value, Column):
        return value
    if isinstance(value, float) and isinstance(kind, T.IntegralType):
        return F.lit(value)
    return F.lit(value).cast(kind)


def compare(df: DataFrame, op: str, value) -> DataFrame:
    """Every cell compared with a value, which is cast to the column's type; null stays null."""
    return each(df, lambda c, kind: _COMPARE[op](c, _operand(value, kind)))


def logical(df: DataFrame, op: str, value: bool | Column) -> DataFrame:
    """``&`` or ``|`` of boolean columns and a value."""
    _all_boolean(df)
    x = value if isinstance(value, Column) else F.lit(bool(value))
    return each(df, lambda c, _: c & x if op == "&" else c | x)


def _all_boolean(df: DataFrame) -> None:
    if any(not isinstance(f.dataType, T.BooleanType) for f in df.schema):
        raise ValueError("only boolean columns can be combined or inverted")


def invert(df: DataFrame) -> DataFrame:
    """``~`` of boolean columns; ValueError for others."""
    _all_boolean(df)
    return each(df, lambda c, _: ~c)


def math(df: DataFrame, op: str, value) -> DataFrame:
    """``+ - * /`` of every column and a value. Division is of doubles, by IEEE rules; ``+`` concatenates text."""

    def one(c: Column, kind: T.DataType) -> Column:
        x = value if isinstance(value, Column) else F.lit(value)
        if op == "+" and isinstance(kind, T.StringType):
            return F.concat(c, x.cast("string"))
        return _MATH[op](c, x)

    return each(df, one)


def negate(df: DataFrame) -> DataFrame:
    """Every cell with the other sign; nulls stay null."""
    return each(df, lambda c, _: -c)


def is_null(df: DataFrame) -> DataFrame:
    """Per cell; NaN counts as null, as in pandas."""
    return each(df, lambda c, kind: c.isNull() | F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.isNull())


def not_null(df: DataFrame) -> DataFrame:
    """Per cell, the opposite of ``is_null``: never null itself."""
    return invert(is_null(df))


def fill_null(df: DataFrame, value, columns: Key | Sequence[Key] | None = None) -> DataFrame:
    """Nulls replaced in all columns (or those named); a value that a column's type cannot take raises TypeError."""
    chosen = set(names_of(df, columns))
    for f in df.schema:
        if f.name in chosen and not _fits(value, f.dataType):
            raise TypeError(f"{value!r} does not fit column {f.name} of {f.dataType.simpleString()}")
    return each_named(df, chosen, lambda c, kind: F.coalesce(c, F.lit(value).cast(kind)))


def each_named(df: DataFrame, chosen: set[str], fn: Callable[[Column, T.DataType], Column]) -> DataFrame:
    return df.select(*[fn(col(f.name), f.dataType).alias(f.name) if f.name in chosen else col(f.name) for f in df.schema])


def _fits(value, kind: T.DataType) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, T.NumericType) and not (isinstance(kind, T.IntegralType) and float(value) != int(value))
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    return True


def drop_null(df: DataFrame, axis: int = 0, how: str = "any") -> DataFrame:
    """``axis=1`` drops rows, ``axis=0`` drops columns, with any or all values null (NaN included).

    Dropping columns needs one aggregation to be run at once, since a plan's columns cannot depend on its rows.
    """
    if how not in ("any", "all") or axis not in (0, 1):
        raise ValueError(f"how={how!r}, axis={axis!r}")
    nulls = {f.name: (col(f.name).isNull() | F.isnan(col(f.name))) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else col(f.name).isNull() for f in df.schema}
    if axis == 1:
        test = None
        for c in nulls.values():
            test = c if test is None else (test | c if how == "any" else test & c)
        return df if test is None else df.filter(~test)
    names = list(nulls)
    found = df.agg(F.count("*"), *[F.count(F.when(nulls[c], 1)) for c in names]).first()
    total, counts = found[0], found[1:]
    keep = [c for c, n in zip(names, counts, strict=True) if (n == 0 if how == "any" else n < total or total == 0)]
    return df.select(*[col(c) for c in keep])


def where(df: DataFrame, condition: DataFrame | Column | Sequence[Column], other=None) -> DataFrame:
    """Cells where the condition is true, ``other`` (null by default) elsewhere; a condition for all columns or one for each."""
    conds = [condition] * len(df.columns) if isinstance(condition, Column) else list(condition)
    if len(conds) != len(df.columns):
        raise ValueError(f"{len(conds)} conditions for {len(df.columns)} columns")
    return df.select(*[F.when(p, col(f.name)).otherwise(F.lit(other).cast(f.dataType)).alias(f.name) for p, f in zip(conds, df.schema, strict=True)])


def is_in(df: DataFrame, values: Sequence | Mapping[str, Sequence], skip_null: bool = True) -> DataFrame:
    """Per cell: is it among ``values``?  A mapping has values by column; columns that it does not name are false.

    Values that cannot be compared with a column's type are not in it.  A null cell is in the values only if they hold a
    null and ``skip_null`` is false.
    """

    own = lambda c: values.get(c, []) if isinstance(values, Mapping) else values
    return df.select(*[member(col(f.name), f.dataType, own(f.name), skip_null).alias(f.name) for f in df.schema])


def member(c: Column, kind: T.DataType, values: Sequence, skip_null: bool = True) -> Column:
    """``is_in`` of one column."""
    own = [v for v in values if v is not None and _comparable(v, kind)]
    hit = F.coalesce(c.isin(own), F.lit(False)) if own else F.lit(False)
    return hit | c.isNull() if not skip_null and None in list(values) else hit


def _comparable(v, kind: T.DataType) -> bool:
    if isinstance(v, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(v, (int, float)):
        return isinstance(kind, T.NumericType)
    if isinstance(v, str):
        return isinstance(kind, T.StringType)
    return True


def is_in_table(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Per cell: does ``other`` hold the same value in the column of that name, in the row of the same label?

    ``on`` names the label column of both; it is kept.  Labels of ``other`` must be unique for one row out per row in.
    """
    own = [c for c in df.columns if c != on]
    right = other.toDF(*[f"_o_{c}" for c in other.columns])
    both = df.join(right, col(on).eqNullSafe(col(f"_o_{on}")), "left")
    hit = lambda c: F.coalesce(col(c) == col(f"_o_{c}"), F.lit(False)) if c in other.columns else F.lit(False)
    return both.select(col(on), *[hit(c).alias(c) for c in own])


def as_type(df: DataFrame, to, safe: bool = True) -> DataFrame:
    """Columns cast to a type, or by a mapping of names to types.

    ``safe`` raises where a value does not survive: overflow and unreadable text fail in ANSI casts, and a fraction cast to
    an integer fails by a check.  Otherwise fractions are cut off and what does not fit becomes null.
    """
    kinds = {names_of(df, k)[0]: resolve_type(v) for k, v in to.items()} if isinstance(to, Mapping) else dict.fromkeys(df.columns, resolve_type(to))

    def one(f: T.StructField) -> Column:
        c = col(f.name)
        if f.name not in kinds:
            return c
        kind = kinds[f.name]
        if not safe:
            return c.try_cast(kind).alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)) and isinstance(kind, T.IntegralType):
            loss = c.isNotNull() & (c != F.floor(c))
            return F.when(loss, F.raise_error(F.concat(F.lit(f"{f.name}: would lose the fraction of "), c.cast("string"))).cast(kind)).otherwise(c.cast(kind)).alias(f.name)
        return c.cast(kind).alias(f.name)

    return df.select(*[one(f) for f in df.schema])
