"""Sorting, heads, tails and slices. Nulls count as the largest values; ties have no defined order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.operators.columns import Key, col, fresh, names_of
from gridframe.session import stored


def order(df: DataFrame, by: Key | Sequence[Key], ascending: bool | Sequence[bool] = True, na_position: str | None = None) -> list[Column]:
    """Sort expressions; ``na_position`` (``first`` or ``last``) overrides the place of nulls."""
    names = names_of(df, by)
    ups = [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
    if len(ups) != len(names):
        raise ValueError(f"{len(ups)} directions for {len(names)} columns")
    last = lambda up: up if na_position is None else na_position == "last"
    pick = {(True, True): "asc_nulls_last", (True, False): "asc_nulls_first", (False, True): "desc_nulls_last", (False, False): "desc_nulls_first"}
    return [getattr(col(c), pick[up, last(up)])() for c, up in zip(names, ups, strict=True)]


def sort(df: DataFrame, by: Key | Sequence[Key], ascending: bool | Sequence[bool] = True, na_position: str | None = None, options=None) -> DataFrame:
    """A total order: Spark samples ranges, shuffles by them and sorts within. ``options`` of other engines are ignored."""
    return df.orderBy(*order(df, by, ascending, na_position))


def head(df: DataFrame, n: int, by: Key | Sequence[Key] | None = None, ascending: bool | Sequence[bool] = True) -> DataFrame:
    """The first ``n`` rows, in the order of ``by`` if given; ValueError for a negative ``n``."""
    if n < 0:
        raise ValueError(f"head of {n} rows")
    return (df if by is None else sort(df, by, ascending)).limit(n)


def tail(df: DataFrame, n: int, by: Key | Sequence[Key], ascending: bool | Sequence[bool] = True) -> DataFrame:
    """The last ``n`` rows in the order of ``by`` (all, if there are fewer), found from the other end."""
    if n < 0:
        raise ValueError(f"tail of {n} rows")
    names = names_of(df, by)
    ups = [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
    flipped = [col(c).desc_nulls_first() if up else col(c).asc_nulls_last() for c, up in zip(names, ups, strict=True)]
    return df.orderBy(*flipped).limit(n).orderBy(*order(df, by, ascending))


top_k = head


def placed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with numbers that grow in the order of its rows, with gaps: enough to compare places, without a copy or a job."""
    return df.withColumn(name, F.monotonically_increasing_id())


def with_ordinal(df: DataFrame, name: str = "ordinal", by: Key | Sequence[Key] | None = None, ascending: bool | Sequence[bool] = True, na_position: str | None = None) -> DataFrame:
    """``df`` with each row's position from 0, in the order of ``by`` or else of the source; a column ``name`` is replaced.

    Without a window over all rows: the (sorted) frame is written once to the shared folder, partition by partition, with
    each row's place in its partition; the partitions' row counts, one row a partition, give the offsets.  The result
    itself lies in no particular order.
    """
    rows = df if by is None else sort(df, by, ascending, na_position)
    mid = fresh(df, "_mid")
    placed = stored(rows.withColumn(mid, F.monotonically_increasing_id()), "ordinal")
    part, at = F.shiftright(mid, 33), F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("p")).agg(F.count("*").alias("c"))
    offsets = counts.select(F.struct("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("o")).alias(fresh(placed, "_offset")))
    offset = F.col(offsets.columns[0])
    out = placed.join(offsets, part == offset["p"])
    return out.select(*[col(c) for c in df.columns if c != name], (offset["o"] + at).alias(name))


#: Rows up to which a slice is a limit.
DEEP = 1_000_000


def slice_rows(df: DataFrame, offset: int, length: int, by: Key | Sequence[Key] | None = None, ascending: bool | Sequence[bool] = True) -> DataFrame:
    """``length`` rows from position ``offset``, clamped to what there is.

    Shallow slices are limits; deep ones (over ``DEEP`` rows from the start) are found by ordinals, since a limit brings
    all rows before the slice to one task.  Both give the same rows in the same order.
    """
    if offset < 0 or length < 0:
        raise ValueError(f"slice of {length} rows from {offset}")
    if offset + length <= DEEP:
        return (df if by is None else sort(df, by, ascending)).offset(offset).limit(length)
    name = fresh(df, "_ordinal")
    return with_ordinal(df, name, by, ascending).filter((F.col(name) >= offset) & (F.col(name) < offset + length)).orderBy(name).drop(name)


def merge_sorted(parts: Sequence[DataFrame], by: Key | Sequence[Key], ascending: bool | Sequence[bool] = True) -> DataFrame:
    """Sorted frames as one sorted frame."""
    from gridframe.operators.setops import union_all

    return sort(union_all(parts), by, ascending)
