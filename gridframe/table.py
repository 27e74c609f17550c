"""``Table``: the frame under the names of a table library, where local and distributed calls are told apart.

Both are the same plan here, so every ``distributed_`` name is its local one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa

from gridframe.frame import DataFrame, _spark, concat, merge_tables
from gridframe.operators import joins
from gridframe.sources import memory


class SortOptions:
    """Sampling settings of other engines, accepted and ignored: Spark samples by itself."""

    def __init__(self, num_bins: int = 0, num_samples: int = 0, sampling: str = "regular"):
        self.num_bins, self.num_samples, self.sampling = num_bins, num_samples, sampling


class Table(DataFrame):
    """A frame with a table's constructors and joins; ``context`` is an ``Env`` or None and is ignored."""

    @classmethod
    def from_arrow(cls, context, table: pa.Table) -> Table:
        return cls(memory.from_arrow(_spark(), table))

    @classmethod
    def from_numpy(cls, context, col_names: Sequence[str], ar_list: Sequence[np.ndarray]) -> Table:
        return cls(memory.from_columns(_spark(), ar_list, col_names))

    @classmethod
    def from_list(cls, context, col_names: Sequence[str], data_list: Sequence[Sequence]) -> Table:
        return cls(memory.from_columns(_spark(), data_list, col_names))

    @classmethod
    def from_pydict(cls, context, dictionary: Mapping[str, Sequence]) -> Table:
        return cls(memory.from_pydict(_spark(), dictionary))

    @classmethod
    def from_pandas(cls, context=None, df: pd.DataFrame | None = None, preserve_index: bool = False, **_) -> Table:
        return cls(memory.from_pandas(_spark(), df.reset_index() if preserve_index else df))

    @staticmethod
    def merge_all(tables: Sequence[DataFrame]) -> DataFrame:
        """All rows of tables with one schema."""
        return merge_tables(tables)

    @staticmethod
    def concat(tables: Sequence[DataFrame], axis: int = 0, join: str = "inner", algorithm: str | None = None) -> DataFrame:
        return concat(tables, axis, join)

    distributed_concat = concat

    def join(self, table: DataFrame, join_type: str = "inner", algorithm: str | None = None, on=None, left_on=None, right_on=None, left_prefix: str = "", right_prefix: str = "") -> Table:  # type: ignore[override]
        """By columns given as names or positions; a name on both sides is prefixed (with both prefixes empty, names may repeat, so the right side's are numbered)."""
        if on is not None:
            left_on = right_on = on
        if left_on is None or right_on is None:
            raise ValueError("give 'on', or 'left_on' and 'right_on'")
        a, b = self.to_spark(), table.to_spark()
        out = joins.join(a, b, left_on, right_on, join_type, algorithm, left_prefix, right_prefix)
        seen: set[str] = set()
        names = []
        for c in out.columns:
            while c in seen:
                c += "_1"
            seen.add(c)
            names.append(c)
        return Table(out.toDF(*names))

    distributed_join = join

    def sort(self, order_by, ascending=True, sort_options: SortOptions | None = None) -> DataFrame:  # type: ignore[override]
        return self.sort_values(order_by, ascending=ascending)

    distributed_sort = sort

    def groupby(self, index, agg: Mapping | None = None, groupby_type: str = "hash", **kw):  # type: ignore[override]
        """With ``agg`` the aggregates, without it a group-by object."""
        grouped = super().groupby(index, groupby_type, **kw)
        return grouped if agg is None else grouped.agg(agg)

    def distributed_equals(self, table: DataFrame, ordered: bool = True) -> bool:
        return self.equals(table, ordered)

    def is_retain(self) -> bool:
        return self._src.storageLevel.useMemory
