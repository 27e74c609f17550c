"""A pandas-like frame over a lazy Spark plan.

A ``DataFrame`` is a source plan, named column expressions over it, and label columns (the index).  Operations on cells
only rewrite expressions, so a mask made from a frame compiles to a filter of it, without a join.  Frames of different
sources are put together by row position, which costs a written copy of each (see ``operators.sorting.with_ordinal``).
Positions are those of the source; after an operator that moves rows they have no meaning unless a sort follows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import DataFrame as Plan
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridframe.operators import aggregates, joins, partitioning, relational, setops, sorting, udf
from gridframe.operators.columns import col, fresh
from gridframe.session import Env, local_session
from gridframe.sources import files, memory, sinks
from gridframe.sources.options import CSVReadOptions, CSVWriteOptions

_ORDINAL = "_position"


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or local_session()


def _plan_of(data, columns: Sequence[str] | None) -> Plan:
    spark = _spark()
    if data is None or (isinstance(data, (list, tuple)) and not len(data)):
        return memory.empty(spark)
    if isinstance(data, Plan):
        out = data
    elif isinstance(data, pd.DataFrame):
        out = memory.from_pandas(spark, data)
    elif isinstance(data, pa.Table):
        out = memory.from_arrow(spark, data)
    elif isinstance(data, Series):
        out = memory.from_columns(spark, [data.data], [data.id])
    elif isinstance(data, Mapping):
        out = memory.from_pydict(spark, data)
    elif isinstance(data, np.ndarray):
        out = memory.from_list(spark, [data] if data.ndim == 1 else list(data.T))
    elif isinstance(data, (list, tuple)):
        out = memory.from_list(spark, list(data))
    else:
        raise ValueError(f"no frame can be made of {type(data).__name__}")
    return out if columns is None else relational.rename(out, list(columns))


class Series:
    """An Arrow array with a name."""

    def __init__(self, id: str | None = None, data=None):
        self.id = id if id is not None else "0"
        self.data = data if isinstance(data, (pa.Array, pa.ChunkedArray)) else pa.array([] if data is None else data)

    @property
    def dtype(self) -> pa.DataType:
        return self.data.type

    @property
    def shape(self) -> tuple[int]:
        return (len(self.data),)

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, item):
        return self.data[item]

    def __repr__(self) -> str:
        return f"Series({self.id!r}, {self.data.to_pylist()!r})"


class DataFrame:
    """See the module. ``data``: a Spark DataFrame, pandas frame, Arrow table, dict, Series, array, or list of columns."""

    def __init__(self, data=None, index=None, columns: Sequence[str] | None = None, copy: bool = False):
        if isinstance(data, DataFrame):
            self._src, self._cols, self._index = data._src, list(data._cols), list(data._index)
            if columns is not None:
                self.rename(list(columns))
        else:
            self._src = _plan_of(data, columns)
            if len(set(self._src.columns)) < len(self._src.columns):
                raise ValueError(f"repeated column names: {self._src.columns}")
            self._cols = [(c, col(c)) for c in self._src.columns]
            self._index: list[tuple[str, Column]] = []
        if index is not None:
            self.set_index(index)

    # --- plumbing ---

    @classmethod
    def _of(cls, src: Plan, cols=None, index=()) -> DataFrame:
        out = cls.__new__(cls)
        out._src, out._index = src, list(index)
        out._cols = [(c, col(c)) for c in src.columns] if cols is None else list(cols)
        return out

    def _like(self, cols) -> DataFrame:
        return self._of(self._src, cols, self._index)

    def to_spark(self, with_index: bool = False) -> Plan:
        """The frame as a Spark DataFrame; label columns come first if wanted."""
        cols = [e.alias(c) for c, e in self._cols]
        labels = [e.alias(self._label(i)) for i, (_, e) in enumerate(self._index)] if with_index else []
        return self._src.select(*labels, *cols)

    def _label(self, i: int) -> str:
        return f"_label{i}"

    def _settled(self) -> DataFrame:
        """The same frame with its columns and labels computed into the source."""
        src = self.to_spark(with_index=True)
        return self._of(src, [(c, col(c)) for c in self.columns], [(n, col(self._label(i))) for i, (n, _) in enumerate(self._index)])

    def _apply(self, fn: Callable[[Plan], Plan]) -> DataFrame:
        """``fn`` of the columns as a plan; labels do not survive."""
        return self._of(fn(self.to_spark()))

    def _expr(self, key) -> Column:
        return self._cols[self._at(key)][1]

    def _at(self, key) -> int:
        if isinstance(key, (int, np.integer)) and not isinstance(key, bool):
            if not -len(self._cols) <= key < len(self._cols):
                raise IndexError(f"column {key} of {len(self._cols)}")
            return int(key) % len(self._cols)
        for i, (c, _) in enumerate(self._cols):
            if c == key:
                return i
        raise KeyError(key)

    def _names(self, keys) -> list[str]:
        return [self._cols[self._at(k)][0] for k in (keys if isinstance(keys, (list, tuple)) else [keys])]

    @property
    def _kinds(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.to_spark().schema}

    # --- properties ---

    @property
    def columns(self) -> list[str]:
        return [c for c, _ in self._cols]

    column_names = columns

    @property
    def shape(self) -> tuple[int, int]:
        """Counts the rows: an action."""
        return len(self), len(self._cols)

    @property
    def dtypes(self) -> dict[str, str]:
        return {c: k.simpleString() for c, k in self._kinds.items()}

    @property
    def empty(self) -> bool:
        return not self._cols or self._src.isEmpty()

    @property
    def values(self) -> np.ndarray:
        return self.to_numpy()

    column_count = property(lambda self: len(self._cols))
    row_count = property(lambda self: len(self))

    def __len__(self) -> int:
        return self._src.count()

    # --- out ---

    def to_pandas(self) -> pd.DataFrame:
        out = self.to_spark(with_index=True).toPandas()
        labels = [self._label(i) for i in range(len(self._index))]
        return out.set_index(labels).rename_axis([n for n, _ in self._index]) if labels else out

    def to_numpy(self, order: str = "F", zero_copy_only: bool = True, writable: bool = False) -> np.ndarray:
        return sinks.to_numpy(self.to_spark(), order)

    def to_arrow(self) -> pa.Table:
        return sinks.to_arrow(self.to_spark())

    def to_dict(self, with_index: bool = False) -> dict:
        if with_index and self._index:
            return self.to_pandas().to_dict()
        return sinks.to_dict(self.to_spark())

    to_pydict = to_dict

    def to_table(self) -> DataFrame:
        return self

    def to_csv(self, path: str, options: CSVWriteOptions | None = None, name_function: Callable[[int], str] | None = None, env: Env | None = None) -> None:
        sinks.write_csv(self.to_spark(), path, options, name_function=name_function)

    def to_parquet(self, path: str, options=None, name_function: Callable[[int], str] | None = None, env: Env | None = None) -> None:
        sinks.write_parquet(self.to_spark(), path, options, name_function=name_function)

    def to_json(self, path: str, name_function: Callable[[int], str] | None = None, env: Env | None = None) -> None:
        sinks.write_json(self.to_spark(), path, name_function=name_function)

    def iterrows(self):
        """(label, values) of each row, fetched a partition at a time; without labels, the position."""
        n = len(self._index)
        for i, r in enumerate(self.to_spark(with_index=True).toLocalIterator()):
            yield (r[0] if n == 1 else tuple(r[:n]) if n else i), list(r[n:])

    def to_string(self, row_limit: int = 10) -> str:
        return self.to_spark().limit(row_limit).toPandas().to_string()

    def show(self, row1: int = 0, row2: int = 10, col1: int = 0, col2: int | None = None) -> None:
        """Rows and columns from the first to before the second number."""
        cols = self.columns[max(col1, 0) : col2 if col2 is None or col2 >= 0 else None]
        end = row2 if row2 >= 0 else 10
        print(self[cols].slice(max(row1, 0), max(end - max(row1, 0), 0)).to_pandas().to_string())

    def __repr__(self) -> str:
        return self.to_string()

    # --- items ---

    def __getitem__(self, item) -> DataFrame:
        if isinstance(item, tuple) and len(item) == 2 and (item[1] is None or isinstance(item[1], Env)):
            item = item[0]
        if isinstance(item, DataFrame):
            return self._masked(item)
        if isinstance(item, slice):
            if item.step not in (None, 1):
                raise ValueError("slices have no step")
            start = item.start or 0
            if item.stop is None:
                return self.slice(start, len(self))
            return self.slice(start, max(0, item.stop - start))
        if isinstance(item, (int, np.integer)):
            return self.slice(int(item), 1)
        keys = item if isinstance(item, list) else [item]
        return self._like([self._cols[self._at(k)] for k in keys])

    def _masked(self, mask: DataFrame) -> DataFrame:
        left, right = _together(self, mask)
        if len(right._cols) == 1:
            return left._of(left._src.filter(right._cols[0][1]), left._cols, left._index)
        return left.where(right)

    def __setitem__(self, key, value) -> None:
        """Replace or append a column: a value, or a frame of one column, by position."""
        names = key if isinstance(key, list) else [key]
        if isinstance(value, DataFrame):
            if len(value._cols) != len(names):
                raise ValueError(f"{len(value._cols)} columns for {len(names)} names")
            left, right = _together(self, value)
            self._src, self._cols, self._index = left._src, left._cols, left._index
            new = [e for _, e in right._cols]
        elif isinstance(value, (list, np.ndarray, pa.Array, Series)):
            self[key] = DataFrame([list(value.data.to_pylist()) if isinstance(value, Series) else list(value)])
            return
        else:
            new = [value if isinstance(value, Column) else F.lit(value)] * len(names)
        for name, e in zip(names, new, strict=True):
            if name in self.columns:
                self._cols[self._at(name)] = (name, e)
            else:
                self._cols.append((str(name), e))

    def project(self, columns) -> DataFrame:
        return self[list(columns) if isinstance(columns, (list, tuple)) else [columns]]

    def filter(self, predicate: Column | str | Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
        """Rows for which a Column, SQL text or a function of pandas batches holds."""
        s = self._settled()
        return s._of(relational.select(s._src, predicate), s._cols, s._index)

    select = filter

    def drop(self, column_names, inplace: bool = False) -> DataFrame:
        gone = set(self._names(column_names if isinstance(column_names, (list, tuple)) else [column_names]))
        return self._result(self._like([x for x in self._cols if x[0] not in gone]), inplace)

    def _result(self, out: DataFrame, inplace: bool) -> DataFrame:
        if inplace:
            self._src, self._cols, self._index = out._src, out._cols, out._index
            return self
        return out

    def rename(self, column_names) -> DataFrame:
        """In place, by a mapping or all names in order; ValueError for unknown names or another number."""
        if isinstance(column_names, Mapping):
            if missing := set(column_names) - set(self.columns):
                raise ValueError(f"unknown columns {sorted(missing)}")
            names = [column_names.get(c, c) for c in self.columns]
        else:
            names = list(column_names)
            if len(names) != len(self._cols):
                raise ValueError(f"{len(names)} names for {len(self._cols)} columns")
        self._cols = [(n, e) for n, (_, e) in zip(names, self._cols, strict=True)]
        return self

    def add_prefix(self, prefix: str) -> DataFrame:
        return self._like([(prefix + c, e) for c, e in self._cols])

    def add_suffix(self, suffix: str) -> DataFrame:
        return self._like([(c + suffix, e) for c, e in self._cols])

    def add_column(self, position: int, name: str, value) -> DataFrame:
        """In place: a column (value, Column or frame of one column) inserted at ``position``."""
        if not 0 <= position <= len(self._cols):
            raise IndexError(f"position {position} of {len(self._cols)} columns")
        self[name] = value
        self._cols.insert(position, self._cols.pop())
        return self

    def select_dtypes(self, include=None, exclude=None) -> DataFrame:
        keep = relational.select_dtypes(self.to_spark(), include, exclude).columns
        return self[keep]

    # --- cells ---

    def _cells(self, fn: Callable[[Column, T.DataType], Column]) -> DataFrame:
        kinds = self._kinds
        return self._like([(c, fn(e, kinds[c])) for c, e in self._cols])

    def _binary(self, other, fn: Callable[[Column, Column, T.DataType], Column]) -> DataFrame:
        if not isinstance(other, DataFrame):
            return self._cells(lambda e, kind: fn(e, other if isinstance(other, Column) else F.lit(other), kind))
        left, right = _together(self, other)
        if len(right._cols) == 1:
            right._cols = right._cols * len(left._cols)
        if len(right._cols) != len(left._cols):
            raise ValueError(f"{len(left._cols)} columns with {len(right._cols)}")
        kinds = left._kinds
        return left._like([(c, fn(e, r, kinds[c])) for (c, e), (_, r) in zip(left._cols, right._cols, strict=True)])

    def _compare(self, op: str, other) -> DataFrame:
        fn = relational._COMPARE[op]
        if isinstance(other, DataFrame):
            return self._binary(other, lambda a, b, _: fn(a, b))
        return self._cells(lambda a, kind: fn(a, relational._operand(other, kind)))

    def __eq__(self, other) -> DataFrame:  # type: ignore[override]
        return self._compare("==", other)

    def __ne__(self, other) -> DataFrame:  # type: ignore[override]
        return self._compare("!=", other)

    def __lt__(self, other) -> DataFrame:
        return self._compare("<", other)

    def __gt__(self, other) -> DataFrame:
        return self._compare(">", other)

    def __le__(self, other) -> DataFrame:
        return self._compare("<=", other)

    def __ge__(self, other) -> DataFrame:
        return self._compare(">=", other)

    __hash__ = None  # type: ignore[assignment]

    def _boolean(self) -> None:
        if any(not isinstance(k, T.BooleanType) for k in self._kinds.values()):
            raise ValueError("only boolean columns can be combined or inverted")

    def __and__(self, other) -> DataFrame:
        self._boolean()
        return self._binary(other, lambda a, b, _: a & b)

    def __or__(self, other) -> DataFrame:
        self._boolean()
        return self._binary(other, lambda a, b, _: a | b)

    def __invert__(self) -> DataFrame:
        self._boolean()
        return self._cells(lambda e, _: ~e)

    def __neg__(self) -> DataFrame:
        return self._cells(lambda e, _: -e)

    def __add__(self, other) -> DataFrame:
        return self._binary(other, lambda a, b, kind: F.concat(a, b) if isinstance(kind, T.StringType) else a + b)

    def __sub__(self, other) -> DataFrame:
        return self._binary(other, lambda a, b, _: a - b)

    def __mul__(self, other) -> DataFrame:
        return self._binary(other, lambda a, b, _: a * b)

    def __truediv__(self, other) -> DataFrame:
        return self._binary(other, lambda a, b, _: relational.scalar.divide(a, b))

    def isnull(self) -> DataFrame:
        return self._cells(lambda e, kind: e.isNull() | F.isnan(e) if isinstance(kind, (T.FloatType, T.DoubleType)) else e.isNull())

    isna = isnull

    def notnull(self) -> DataFrame:
        return ~self.isnull()

    notna = notnull

    def fillna(self, fill_value) -> DataFrame:
        for c, kind in self._kinds.items():
            if not relational._fits(fill_value, kind):
                raise TypeError(f"{fill_value!r} does not fit column {c} of {kind.simpleString()}")
        return self._cells(lambda e, kind: F.coalesce(e, F.lit(fill_value).cast(kind)))

    def where(self, condition: DataFrame | None = None, other=None) -> DataFrame:
        if condition is None:
            raise ValueError("where needs a condition")
        return self._binary(condition, lambda a, p, kind: F.when(p, a).otherwise(F.lit(other).cast(kind)))

    def dropna(self, axis: int = 0, how: str = "any", inplace: bool = False) -> DataFrame:
        """``axis=1`` drops rows, ``axis=0`` columns (which runs an aggregation)."""
        s = self._settled()
        kept = relational.drop_null(s._src.select(*[col(c) for c in s.columns]), axis, how) if axis == 0 else None
        if kept is not None:
            return self._result(self[kept.columns], inplace)
        test = reduce(lambda a, b: a | b if how == "any" else a & b, [e for _, e in s.isnull()._cols])
        return self._result(s._of(s._src.filter(~test), s._cols, s._index), inplace)

    def isin(self, values, skip_null: bool = True) -> DataFrame:
        """Membership in a list, in lists by column, or in a frame (same column and same label or position)."""
        if not isinstance(values, DataFrame):
            s = self._settled()
            kinds = s._kinds
            return s._like([(c, relational.member(e, kinds[c], values.get(c, []) if isinstance(values, Mapping) else values, skip_null)) for c, e in s._cols])
        left, right = (x if x._index else x._positioned() for x in (self, values))
        lab = lambda f: f._src.select(f._index[0][1].alias("_on"), *[e.alias(c) for c, e in f._cols])
        return self._of(relational.is_in_table(lab(left), lab(right), "_on"), [(c, col(c)) for c in self.columns], [(left._index[0][0], col("_on"))] if self._index else [])

    def applymap(self, func, na_action=None, dtype=None) -> DataFrame:
        if na_action is not None:
            raise NotImplementedError("na_action")
        return self._apply(lambda p: udf.apply_map(p, func, dtype))

    def infer_map(self, func, dtype=None) -> DataFrame:
        return self._apply(lambda p: udf.infer_map(p, func, dtype))

    def astype(self, dtype, safe: bool = True) -> DataFrame:
        return self._apply(lambda p: relational.as_type(p, dtype, safe)) if not self._index else self._keep_index(lambda p: relational.as_type(p, dtype if isinstance(dtype, Mapping) else {c: dtype for c in self.columns}, safe))

    def _keep_index(self, fn: Callable[[Plan], Plan]) -> DataFrame:
        s = self._settled()
        return self._of(fn(s._src), s._cols, s._index)

    def get_hash_object(self, index: bool = True, **_) -> DataFrame:
        """A 64-bit hash of each row."""
        labels = [e for _, e in self._index] if index else []
        return self._like([("hash", F.xxhash64(*labels, *[e for _, e in self._cols]))])

    # --- labels ---

    @property
    def index(self) -> Index:
        return Index(self)

    def _positioned(self) -> DataFrame:
        """The frame with positions as its labels."""
        s = self._settled()
        name = fresh(s._src, _ORDINAL)
        src = sorting.with_ordinal(s._src, name).orderBy(name)
        return self._of(src, s._cols, [(name, col(name))])

    def set_index(self, key, indexing_type=None, drop: bool = True) -> DataFrame:
        """In place: labels from a column, several columns, or a list of as many labels as rows."""
        one = isinstance(key, (str, int)) and not isinstance(key, bool)
        keys = [key] if one else list(getattr(key, "index_values", key))
        if one or all(isinstance(k, str) and k in self.columns for k in keys) and keys:
            at = [self._at(k) for k in keys]
            self._index = [self._cols[i] for i in at]
            if drop:
                self._cols = [x for i, x in enumerate(self._cols) if i not in at]
            return self
        labels = DataFrame([keys])
        if len(keys) != len(self):
            raise ValueError(f"{len(keys)} labels for {len(self)} rows")
        left, right = _together(self, labels)
        self._src, self._cols, self._index = left._src, left._cols, [("index", right._cols[0][1])]
        return self

    def reset_index(self, drop: bool = False) -> DataFrame:
        """In place: labels become the first column, ``index`` (or the names of several); with ``drop`` they go."""
        if not drop and self._index:
            names = ["index"] if len(self._index) == 1 else [n for n, _ in self._index]
            self._cols = [(n, e) for n, (_, e) in zip(names, self._index, strict=True)] + self._cols
        self._index = []
        return self

    @property
    def loc(self) -> _Loc:
        return _Loc(self)

    @property
    def iloc(self) -> _ILoc:
        return _ILoc(self)

    # --- rows ---

    def slice(self, offset: int, length: int) -> DataFrame:
        s = self._settled()
        return self._of(sorting.slice_rows(s._src, offset, length), s._cols, s._index)

    def head(self, n: int = 5, env: Env | None = None) -> DataFrame:
        s = self._settled()
        return self._of(sorting.head(s._src, n), s._cols, s._index)

    def tail(self, n: int = 5, env: Env | None = None) -> DataFrame:
        """The last rows by position: counts, then slices."""
        if n < 0:
            raise ValueError(f"tail of {n} rows")
        total = len(self)
        return self.slice(max(0, total - n), min(n, total))

    def sort_values(self, by, axis: int = 0, ascending=True, inplace: bool = False, na_position: str | None = None, env: Env | None = None) -> DataFrame:
        """Rows in the order of columns; nulls are the largest unless ``na_position`` says ``first`` or ``last``. ``axis`` can only be 0."""
        if axis:
            raise ValueError("only rows can be sorted")
        s = self._settled()
        out = self._of(sorting.sort(s._src, self._names(by), ascending, na_position), s._cols, s._index)
        return self._result(out, inplace)

    sort = sort_values

    def sort_index(self, ascending=True, na_position: str | None = None, env: Env | None = None) -> DataFrame:
        s = self._settled()
        return self._of(sorting.sort(s._src, [self._label(i) for i in range(len(s._index))], ascending, na_position), s._cols, s._index) if s._index else s

    # --- two frames ---

    def join(self, other: DataFrame, on=None, how: str = "left", lsuffix: str = "l", rsuffix: str = "r", algorithm: str | None = None, sort: bool = False, env: Env | None = None) -> DataFrame:
        """With the labels of ``other``: by ``on``, or by own labels. Names on both sides are prefixed; ``sort`` orders by the keys.

        Without ``algorithm`` Spark chooses, and broadcasts a side that it knows to be small.
        """
        if not other._index:
            raise ValueError("the other frame has no labels to join on")
        a, b = self._settled(), other._settled()
        left = self._names(on) if on is not None else [self._label(i) for i in range(len(a._index))]
        if not left:
            raise ValueError("neither 'on' nor labels to join by")
        return self._joined(a, b, left, [other._label(i) for i in range(len(b._index))], how, algorithm, (lsuffix, rsuffix), True, sort=sort)

    def merge(self, right: DataFrame, how: str = "inner", algorithm: str | None = None, on=None, left_on=None, right_on=None, left_index: bool = False, right_index: bool = False, sort: bool = False, suffixes: tuple[str, str] = ("_x", "_y"), style: str = "prefix", nulls_equal: bool = True, env: Env | None = None) -> DataFrame:
        """Both copies of the keys stay; names on both sides are marked before them, or after with ``style='suffix'``; ``sort`` orders by the keys."""
        if on is not None:
            if left_on is not None or right_on is not None or left_index or right_index:
                raise ValueError("'on' excludes the other ways to name keys")
            left_on = right_on = on
        elif left_on is None and right_on is None and not left_index and not right_index:
            left_on = right_on = [c for c in self.columns if c in right.columns]
            if not left_on:
                raise ValueError("no common columns to merge on")
        a, b = self._settled(), right._settled()
        lk = [self._label(i) for i in range(len(a._index))] if left_index else self._names(left_on)
        rk = [right._label(i) for i in range(len(b._index))] if right_index else right._names(right_on)
        return self._joined(a, b, lk, rk, how, algorithm, suffixes, style == "prefix", nulls_equal, sort)

    def _joined(self, a, b, left, right, how, algorithm, marks, before: bool, nulls_equal: bool = True, sort: bool = False) -> DataFrame:
        names = joins.joined_names(a.columns, b.columns, marks if before else ("", ""), ("", "") if before else marks)
        x = a._src.toDF(*[f"_a{i}" for i in range(len(a._src.columns))])
        y = b._src.toDF(*[f"_b{i}" for i in range(len(b._src.columns))])
        at = lambda f, mark, n: f"{mark}{f._src.columns.index(n)}"
        out = joins.join(x, y, [at(a, "_a", k) for k in left], [at(b, "_b", k) for k in right], how, algorithm, nulls_equal=nulls_equal)
        if sort:
            pairs = [(col(at(a, "_a", x)), col(at(b, "_b", y))) for x, y in zip(left, right, strict=True)]
            out = out.orderBy(*[(x if how in ("semi", "anti") else F.coalesce(x, y)).asc_nulls_last() for x, y in pairs])
        cols = [col(at(a, "_a", c)) for c in a.columns] + ([] if how in ("semi", "anti") else [col(at(b, "_b", c)) for c in b.columns])
        names = names[: len(cols)]
        if len(set(names)) < len(names):
            raise ValueError(f"names would repeat: {names}; give other suffixes")
        return self._of(out.select(*[c.alias(n) for c, n in zip(cols, names, strict=True)]))

    def union(self, other: DataFrame, env: Env | None = None) -> DataFrame:
        return self._of(setops.union(self.to_spark(), other.to_spark()))

    def subtract(self, other: DataFrame, env: Env | None = None) -> DataFrame:
        return self._of(setops.subtract(self.to_spark(), other.to_spark()))

    def intersect(self, other: DataFrame, env: Env | None = None) -> DataFrame:
        return self._of(setops.intersect(self.to_spark(), other.to_spark()))

    distributed_union, distributed_subtract, distributed_intersect = union, subtract, intersect

    def set_union(self, other: DataFrame, subset=None, env: Env | None = None) -> DataFrame:
        return self._of(setops.set_union(self.to_spark(), other.to_spark(), subset))

    def set_difference(self, other: DataFrame, subset=None, env: Env | None = None) -> DataFrame:
        return self._of(setops.set_difference(self.to_spark(), other.to_spark(), subset))

    def set_intersect(self, other: DataFrame, subset=None, env: Env | None = None) -> DataFrame:
        return self._of(setops.set_intersect(self.to_spark(), other.to_spark(), subset))

    def equals(self, other: DataFrame, ordered: bool = True, env: Env | None = None) -> bool:
        return setops.equals(self.to_spark(), other.to_spark(), ordered)

    def drop_duplicates(self, subset=None, keep: str = "first", inplace: bool = False, ignore_index: bool = False, env: Env | None = None) -> DataFrame:
        """One row for each value of ``subset``; first and last are by position."""
        if keep not in ("first", "last", "any"):
            raise ValueError(f"keep={keep!r}")
        s = self._settled()
        names = self._names(subset) if subset is not None else self.columns
        if keep == "any" or (set(names) == set(self.columns) and not s._index):
            out = setops.unique(s._src, names)
        else:
            name = fresh(s._src, _ORDINAL)
            out = setops.unique(sorting.placed(s._src, name), names, keep, name)
        return self._result(self._of(out, s._cols, [] if ignore_index else s._index), inplace)

    def unique(self, columns=None, keep: str = "first", inplace: bool = False) -> DataFrame:
        return self.drop_duplicates(columns, keep, inplace)

    distributed_unique = unique

    # --- aggregates ---

    def groupby(self, by=None, groupby_type: str = "hash", dropna: bool = False, level=None, as_index: bool = False, sort: bool = False, env: Env | None = None) -> GroupBy:
        """Groups by columns (``by``) or by labels (``level``, a name or position of one or several).

        ``groupby_type``: ``hash`` names results ``op_column``, ``mapred_hash`` ``column_op``, ``pipeline`` ``column``.  With
        ``as_index`` the keys of results are labels instead of columns; with ``sort`` results are in the order of the keys.
        """
        if (by is None) == (level is None):
            raise ValueError("give either 'by' or 'level'")
        frame = self
        if level is not None:
            wanted = [level] if isinstance(level, (str, int)) else list(level)
            labels = self.index.names
            by = [labels[k] if isinstance(k, int) else k for k in wanted]
            if not labels or any(k not in labels for k in by):
                raise KeyError(f"no label among {level!r}")
            s = self._settled()
            frame = self._of(s._src, [*((n, e) for n, (_, e) in zip(labels, s._index, strict=True)), *((c, e) for c, e in s._cols if c not in labels)])
        return GroupBy(frame, frame._names(by), {"hash": "prefix", "mapred_hash": "suffix", "pipeline": "plain"}[groupby_type], dropna, None, as_index, sort)

    def agg(self, spec: Mapping, **kw) -> DataFrame:
        return self._apply(lambda p: aggregates.aggregate(p, spec, **kw))

    def _reduced(self, op: str, column=None, **kw) -> DataFrame:
        names = self.columns if column is None else self._names(column)
        return self._apply(lambda p: aggregates.aggregate(p, {c: op for c in names}, **kw).toDF(*names))

    def sum(self, column=None, skipna: bool = True) -> DataFrame:
        return self._reduced("sum", column, skip_nulls=skipna)

    def count(self, column=None) -> DataFrame:
        return self._reduced("cnt", column)

    def min(self, column=None, skipna: bool = True) -> DataFrame:
        return self._reduced("min", column, skip_nulls=skipna)

    def max(self, column=None, skipna: bool = True) -> DataFrame:
        return self._reduced("max", column, skip_nulls=skipna)

    def mean(self, column=None, skipna: bool = True) -> DataFrame:
        return self._reduced("mean", column, skip_nulls=skipna)

    def var(self, column=None, ddof: int = 1, skipna: bool = True) -> DataFrame:
        return self._reduced("var", column, ddof=ddof, skip_nulls=skipna)

    def std(self, column=None, ddof: int = 1, skipna: bool = True) -> DataFrame:
        return self._reduced("std", column, ddof=ddof, skip_nulls=skipna)

    def nunique(self, column=None) -> DataFrame:
        return self._reduced("nunique", column)

    def median(self, column=None) -> DataFrame:
        return self._reduced("median", column)

    def quantile(self, q: float = 0.5, column=None) -> DataFrame:
        return self._reduced("quantile", column, q=q)

    def all_reduce(self, op: str, column=None) -> DataFrame:
        return self._apply(lambda p: aggregates.all_reduce(p, op, column))

    # --- where rows lie ---

    def shuffle(self, on=None, n: int | None = None, env: Env | None = None) -> DataFrame:
        return self._keep_index(lambda p: partitioning.shuffle(p, self._names(on) if on is not None else self.columns, n))

    def hash_partition(self, on, n: int) -> dict[int, DataFrame]:
        return {i: self._of(p) for i, p in partitioning.hash_partition(self.to_spark(), self._names(on), n).items()}

    def repartition(self, rows_per_partition, receive_build_rank_order=None, env: Env | None = None) -> DataFrame:
        """Exactly so many rows in each partition, handed out in order or in the given order of partitions."""
        return self._keep_index(lambda p: partitioning.repartition(p, list(rows_per_partition), receive_order=receive_build_rank_order))

    def evenly_partition(self, n: int | None = None, env: Env | None = None) -> DataFrame:
        return self._keep_index(lambda p: partitioning.repartition_evenly(p, n or self._src.sparkSession.sparkContext.defaultParallelism))

    def round_robin(self, n: int) -> DataFrame:
        return self._keep_index(lambda p: partitioning.round_robin(p, n))

    def gather(self, env: Env | None = None) -> DataFrame:
        return self._keep_index(partitioning.gather)

    def allgather(self, env: Env | None = None) -> DataFrame:
        return self._keep_index(partitioning.all_gather)

    broadcast = allgather

    def row_counts_for_all(self, env: Env | None = None) -> list[int]:
        """Rows of each partition that has any, a number a partition."""
        return [r.rows for r in partitioning.row_counts(self._src).orderBy("partition").collect()]

    def retain_memory(self, retain: bool = True) -> None:
        """Keep the source's rows in executors' memory and disk, or let go of them."""
        self._src.persist() if retain else self._src.unpersist()

    def to_cpu(self) -> DataFrame:
        return self

    def to_device(self, device=None) -> DataFrame:
        return self

    def is_cpu(self) -> bool:
        return True

    def is_device(self, device=None) -> bool:
        return False

    def register(self, name: str) -> None:
        """Make the frame a view of that name."""
        self.to_spark().createOrReplaceTempView(name)


def _together(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames over one source: as they are if they share it, else joined by position (row counts must be equal)."""
    if a._src is b._src:
        return a._of(a._src, a._cols, a._index), b._of(b._src, b._cols, b._index)
    x, y = a._settled(), b._settled()
    left = sorting.with_ordinal(x._src.toDF(*[f"_a{i}" for i in range(len(x._src.columns))]), "_p")
    right = sorting.with_ordinal(y._src.toDF(*[f"_b{i}" for i in range(len(y._src.columns))]), "_q")
    if left.count() != right.count():
        raise ValueError("frames of different lengths")
    # a later operation by position needs this order; the optimizer drops the sort where nothing does
    src = left.join(right, F.col("_p") == F.col("_q")).orderBy("_p")
    over = lambda f, m: ([(c, F.col(f"{m}{f._src.columns.index(c)}")) for c in f.columns], [(n, F.col(f"{m}{i}")) for i, (n, _) in enumerate(f._index)])
    return DataFrame._of(src, *over(x, "_a")), DataFrame._of(src, *over(y, "_b"))


class GroupBy:
    """A frame about to be aggregated by group."""

    def __init__(self, frame: DataFrame, by: list[str], naming: str, dropna: bool = False, only: list[str] | None = None, as_index: bool = False, sort: bool = False):
        self._frame, self._by, self._naming, self._dropna, self._as_index, self._sort = frame, by, naming, dropna, as_index, sort
        self._only = only or [c for c in frame.columns if c not in by]

    def __getitem__(self, columns) -> GroupBy:
        return GroupBy(self._frame, self._by, self._naming, self._dropna, self._frame._names(columns), self._as_index, self._sort)

    def _grouped(self, fn: Callable[[Plan], Plan]) -> DataFrame:
        """What ``fn`` makes of the frame, a row a group, sorted and labelled as asked for."""
        out = self._frame._apply(lambda p: fn(p.dropna(subset=self._by) if self._dropna else p))
        if self._sort:
            out = out.sort_values(self._by)
        if self._as_index:
            out.set_index(self._by if len(self._by) > 1 else self._by[0])
        return out

    def agg(self, spec: Mapping | str | Sequence[str], q: float = 0.5, ddof: int = 1) -> DataFrame:
        if not isinstance(spec, Mapping):
            spec = {c: spec for c in self._only}
        spec = {self._frame._names(k)[0]: v for k, v in spec.items()}
        return self._grouped(lambda p: aggregates.group_by(p, self._by, spec, self._naming, ddof, q))

    def __getattr__(self, op: str):
        if op in aggregates.OPS:
            return lambda **kw: self.agg(op, **kw)
        raise AttributeError(op)

    def size(self) -> DataFrame:
        return self._grouped(lambda p: aggregates.group_by(p, self._by, {}))

    @property
    def groups(self) -> DataFrame:
        """The distinct keys."""
        return self._grouped(lambda p: p.select(*[col(k) for k in self._by]).distinct())

    def _ordered(self, order_by) -> tuple[DataFrame, list[str]]:
        """The frame with columns that order its rows: those given, or one in the order of its rows."""
        if order_by is not None:
            return self._frame, self._frame._names(order_by)
        s = self._frame._settled()
        name = fresh(s._src, _ORDINAL)
        return self._frame._of(sorting.placed(s._src, name), [*s._cols, (name, col(name))]), [name]

    def _end(self, last: bool, order_by) -> DataFrame:
        frame, order = self._ordered(order_by)
        return GroupBy(frame, self._by, self._naming, self._dropna, self._only, self._as_index, self._sort)._grouped(lambda p: aggregates.ends(p, self._by, self._only, order, last))

    def first(self, order_by=None) -> DataFrame:
        """The first value that is not null of each column, in a stated order or that of the rows."""
        return self._end(False, order_by)

    def last(self, order_by=None) -> DataFrame:
        """As ``first``, from the end."""
        return self._end(True, order_by)

    def _running(self, op: str, order_by) -> DataFrame:
        frame, order = self._ordered(order_by)
        kept = self._frame.columns
        return frame._apply(lambda p: aggregates.running(p, self._by, self._only, op, order, self._dropna).select(*[col(c) for c in kept]))

    def cumsum(self, order_by=None) -> DataFrame:
        """Every row, its values replaced by the group's sums up to it; null where the row's own value is."""
        return self._running("sum", order_by)

    def cummin(self, order_by=None) -> DataFrame:
        return self._running("min", order_by)

    def cummax(self, order_by=None) -> DataFrame:
        return self._running("max", order_by)

    def cumprod(self, order_by=None) -> DataFrame:
        return self._running("prod", order_by)

    def cumcount(self, order_by=None) -> DataFrame:
        """Every row, its values replaced by its number in the group, from 0."""
        return self._running("count", order_by)

    def idxmin(self, label) -> DataFrame:
        """The value of column ``label`` in the row with each column's smallest value."""
        return self._grouped(lambda p: aggregates.labels_of(p, self._by, self._only, label, False))

    def idxmax(self, label) -> DataFrame:
        """The value of column ``label`` in the row with each column's largest value."""
        return self._grouped(lambda p: aggregates.labels_of(p, self._by, self._only, label, True))

    def nth(self, n: int, order_by) -> DataFrame:
        return self._frame._apply(lambda p: aggregates.nth(p, self._by, n, order_by))

    def rolling(self, window: int, op: str, order_by, column: str | None = None, min_periods: int | None = None) -> DataFrame:
        names = [column] if column else self._only
        return self._frame._apply(lambda p: reduce(lambda q, c: aggregates.rolling(q, self._by, c, window, op, order_by, min_periods), names, p))

    def apply(self, fn, schema) -> DataFrame:
        return self._frame._apply(lambda p: udf.apply_groups(p, self._by, fn, schema))

    apply_grouped = apply

    def pipe(self, fn, *args, **kw):
        return fn(self, *args, **kw)

    def __iter__(self):
        """(key, frame) of each group; meant for few groups, since each is a plan of its own."""
        p = self._frame.to_spark()
        for r in self.groups.to_spark().toLocalIterator():
            test = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.lit(v)) for k, v in zip(self._by, r, strict=True)])
            yield (r[0] if len(r) == 1 else tuple(r)), DataFrame._of(p.filter(test))


class Index:
    """The labels of a frame; without any, its positions."""

    def __init__(self, frame: DataFrame):
        self._frame = frame

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self._frame._index]

    @property
    def values(self) -> np.ndarray:
        f = self._frame
        if not f._index:
            return np.arange(len(f))
        rows = f._src.select(*[e for _, e in f._index]).toPandas().to_numpy()
        return rows[:, 0] if rows.shape[1] == 1 else rows

    @property
    def index_values(self) -> list:
        return self.values.tolist()

    def isin(self, values: Sequence) -> list[bool]:
        """A truth value a row, in the driver's memory; ``loc`` and masks are the ways that stay distributed."""
        f = self._frame
        if not f._index:
            return [i in set(values) for i in range(len(f))]
        return [bool(r[0]) for r in f._src.select(F.coalesce(f._index[0][1].isin(list(values)), F.lit(False))).collect()]

    def __len__(self) -> int:
        return len(self._frame)


class RangeIndex:
    """Labels start, start + step ... before stop."""

    def __init__(self, data: range | None = None, start: int = 0, stop: int = 0, step: int = 1):
        r = data if data is not None else range(start, stop, step or 1)
        self.start, self.stop, self.step, self.index_values = r.start, r.stop, r.step, list(r)


class _Labels:
    """Labels from a sequence of values."""

    def __init__(self, data: Sequence):
        self.index_values = list(data)


class NumericIndex(_Labels):
    pass


class IntegerIndex(NumericIndex):
    pass


class CategoricalIndex(_Labels):
    pass


class ColumnIndex(_Labels):
    """Labels from columns, given by name."""


class _Picker:
    def __init__(self, frame: DataFrame):
        self._frame = frame

    def __getitem__(self, item) -> DataFrame:
        rows, cols = item if isinstance(item, tuple) else (item, slice(None))
        return self._rows(rows)[self._columns(cols)]


class _Loc(_Picker):
    """By label: one, a list (in its order), or a slice with both ends, which must be unique labels."""

    def _columns(self, item) -> list[str]:
        names = self._frame.columns
        if isinstance(item, slice):
            a = 0 if item.start is None else self._frame._at(item.start)
            b = len(names) if item.stop is None else self._frame._at(item.stop) + 1
            return names[a:b]
        return self._frame._names(item if isinstance(item, list) else [item])

    def _rows(self, item) -> DataFrame:
        f = self._frame if self._frame._index else self._frame._positioned()
        s = f._settled()
        label = col(f._label(0))
        kept = s._index if self._frame._index else []
        if isinstance(item, slice):
            if item.start is None and item.stop is None:
                return f._of(s._src, s._cols, kept)
            at = sorting.with_ordinal(s._src, "_o")
            ends = [x for x in (item.start, item.stop) if x is not None]
            found: dict = {}
            for r in at.filter(label.isin(ends)).select(label.alias("l"), "_o").limit(len(ends) * 2 + 1).collect():
                if r.l in found:
                    raise IndexError(f"label {r.l!r} is not unique")
                found[r.l] = r["_o"]
            if missing := [x for x in ends if x not in found]:
                raise KeyError(missing[0])
            rows = at
            if item.start is not None:
                rows = rows.filter(F.col("_o") >= found[item.start])
            if item.stop is not None:
                rows = rows.filter(F.col("_o") <= found[item.stop])
            return f._of(rows.orderBy("_o"), s._cols, kept)
        labels = item if isinstance(item, list) else [item]
        rows = s._src.filter(label.isin(labels))
        if len(labels) > 1:
            rows = rows.orderBy(F.array_position(F.array(*[F.lit(x) for x in labels]), label))
        return f._of(rows, s._cols, kept)


class _ILoc(_Picker):
    """By position: one, a list (in its order), or a slice without its end."""

    def _columns(self, item) -> list[str]:
        names = self._frame.columns
        if isinstance(item, slice):
            return names[item]
        return [names[i] for i in (item if isinstance(item, list) else [item])]

    def _rows(self, item) -> DataFrame:
        f = self._frame
        s = f._settled()
        if isinstance(item, slice):
            if item.step not in (None, 1):
                raise ValueError("slices have no step")
            if item.start is None and item.stop is None:
                return s
            n = len(f) if item.stop is None or item.stop < 0 or (item.start or 0) < 0 else None
            a, b, _ = slice(item.start, item.stop).indices(n if n is not None else item.stop)
            return s.slice(a, max(0, b - a))
        at = item if isinstance(item, list) else [item]
        if any(i < 0 for i in at):
            n = len(f)
            at = [i + n if i < 0 else i for i in at]
        rows = sorting.with_ordinal(s._src, "_o").filter(F.col("_o").isin(at))
        if len(at) > 1:
            rows = rows.orderBy(F.array_position(F.array(*[F.lit(i).cast("long") for i in at]), F.col("_o")))
        return s._of(rows, s._cols, s._index)


def concat(objs: Sequence[DataFrame], axis: int = 0, join: str = "inner", ignore_index: bool = False, algorithm: str | None = None, env: Env | None = None) -> DataFrame:
    """Rows of all frames (``axis=0``), or frames side by side by label or position (``axis=1``)."""
    if not objs:
        raise ValueError("nothing to concatenate")
    if axis == 0:
        parts = [o._settled() for o in objs if o._cols]
        keep = not ignore_index and all(p._index for p in parts)
        plans = [p._src if keep else p.to_spark() for p in parts]
        return DataFrame._of(setops.union_all(plans), parts[0]._cols, parts[0]._index if keep else [])
    frames = [o if o._index else o._positioned() for o in objs]
    settled = [f._settled() for f in frames]
    labels = [settled[0]._label(i) for i in range(len(settled[0]._index))]
    plan = setops.concat_columns([s._src for s in settled], labels, join)
    kept = [(n, col(x)) for (n, _), x in zip(settled[0]._index, labels, strict=True)] if objs[0]._index else []
    return DataFrame._of(plan, [(c, col(c)) for c in plan.columns if c not in labels], kept)


def merge_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames with one schema; empty ones are passed over."""
    return concat([t for t in tables if t._cols], ignore_index=True)


def view(name: str) -> DataFrame:
    """A registered frame."""
    return DataFrame(_spark().table(name))


def read_csv(filepath, use_threads: bool = True, names: Sequence[str] | None = None, sep: str = ",", block_size=None, skiprows: int = 0, ignore_emptylines: bool = True, na_values: Sequence[str] | None = None, slice: bool = False, env: Env | None = None, options: CSVReadOptions | None = None) -> DataFrame:
    """CSV files as a frame; ``names`` say that there is no header."""
    o = options or CSVReadOptions(delimiter=sep, skip_rows=skiprows, ignore_empty_lines=ignore_emptylines)
    if names is not None:
        o.header, o.column_names = False, list(names)
    if na_values is not None:
        o.na_values(na_values)
    return DataFrame(files.read_csv(_spark(), filepath, o))


def read_csv_dist(paths, env: Env | None = None, options: CSVReadOptions | None = None) -> DataFrame:
    """Many CSV files whose schemas must be equal."""
    return DataFrame(files.read_csv(_spark(), paths, options, check_schema=not isinstance(paths, str)))


def read_parquet(paths, columns: Sequence[str] | None = None, env: Env | None = None) -> DataFrame:
    return DataFrame(files.read_parquet(_spark(), paths, columns))


def read_json(paths, lines: bool = True, env: Env | None = None) -> DataFrame:
    return DataFrame(files.read_json(_spark(), paths, lines))


read_parquet_dist, read_json_dist = read_parquet, read_json
