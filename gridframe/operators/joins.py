"""Equi-joins with a choice of algorithm, null rule and naming rule; other joins as extensions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.operators.columns import Key, col, fresh, names_of

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "fullouter": "full", "full_outer": "full", "full": "full", "semi": "left_semi", "anti": "left_anti"}
#: Spark's hints for the algorithms. They are followed also where a side is small enough to broadcast; None leaves it to Spark.
HINT = {"sort": "merge", "hash": "shuffle_hash"}


class JoinConfig(NamedTuple):
    """How to join; see ``join``."""

    how: str = "inner"
    left_on: Sequence[Key] = ()
    right_on: Sequence[Key] = ()
    algorithm: str | None = None
    left_prefix: str = ""
    right_prefix: str = ""


def joined_names(left: Sequence[str], right: Sequence[str], before: tuple[str, str], after: tuple[str, str] = ("", "")) -> list[str]:
    """All left, then all right names; a name on both sides is marked before or after, others stay."""
    both = set(left) & set(right)
    mark = lambda c, i: f"{before[i]}{c}{after[i]}" if c in both else c
    return [mark(c, 0) for c in left] + [mark(c, 1) for c in right]


def join(left: DataFrame, right: DataFrame, left_on: Key | Sequence[Key], right_on: Key | Sequence[Key] | None = None, how: str = "inner", algorithm: str | None = None, left_prefix: str = "", right_prefix: str = "", suffixes: tuple[str, str] | None = None, nulls_equal: bool = True) -> DataFrame:
    """All columns of both sides, both copies of the keys included.

    A name on both sides is prefixed (or, with ``suffixes``, suffixed).  Null keys match null keys unless ``nulls_equal``
    is false, which gives SQL's rule.  ``algorithm`` is ``sort``, ``hash`` or None for Spark's own choice, which broadcasts
    a side only after checking its size and splits skewed partitions at run time.
    """
    if how not in HOW:
        raise ValueError(f"unknown join type {how!r}")
    if algorithm is not None and algorithm not in HINT:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    a_on, b_on = names_of(left, left_on), names_of(right, left_on if right_on is None else right_on)
    if len(a_on) != len(b_on) or not a_on:
        raise ValueError(f"{len(a_on)} left keys for {len(b_on)} right keys")
    names = joined_names(left.columns, right.columns, ("", "") if suffixes else (left_prefix, right_prefix), suffixes or ("", ""))
    a = left.toDF(*[f"_l{i}" for i in range(len(left.columns))])
    b = right.toDF(*[f"_r{i}" for i in range(len(right.columns))])
    if algorithm:
        b = b.hint(HINT[algorithm])
    at = lambda df, c: df.columns.index(c)
    pairs = [(F.col(f"_l{at(left, x)}"), F.col(f"_r{at(right, y)}")) for x, y in zip(a_on, b_on, strict=True)]
    on = reduce(lambda x, y: x & y, [x.eqNullSafe(y) if nulls_equal else x == y for x, y in pairs])
    out = a.join(b, on, HOW[how])
    return out.toDF(*(left.columns if how in ("semi", "anti") else names))


def join_with(left: DataFrame, right: DataFrame, config: JoinConfig) -> DataFrame:
    """``join`` by a configuration object."""
    return join(left, right, config.left_on, config.right_on or None, config.how, config.algorithm, config.left_prefix, config.right_prefix)


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, bucket: float, how: str = "inner") -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` whose [low, high) holds ``value``: an extension.

    Values fall into buckets of the given width and ranges are listed under each bucket that they touch, which makes the
    condition an equi-join; a bucket should be about as wide as a typical range.
    """
    mine = fresh(left, "_bucket")
    while mine in right.columns:
        mine = fresh(left, mine + "_")
    other = mine + "_r"
    while other in left.columns or other in right.columns:
        other += "_"
    first = F.floor(col(low) / bucket)
    a = left.withColumn(mine, F.floor(col(value) / bucket))
    b = right.withColumn(other, F.explode(F.sequence(first, F.greatest(first, F.ceil(col(high) / bucket) - 1))))
    cond = (F.col(mine) == F.col(other)) & (col(value) >= col(low)) & (col(value) < col(high))
    return a.join(b, cond, how).drop(mine, other)


def semi_join(left: DataFrame, right: DataFrame, on: Key | Sequence[Key], nulls_equal: bool = True) -> DataFrame:
    """Rows of ``left`` that have a partner: an extension."""
    return join(left, right, on, how="semi", nulls_equal=nulls_equal)


def anti_join(left: DataFrame, right: DataFrame, on: Key | Sequence[Key], nulls_equal: bool = True) -> DataFrame:
    """Rows of ``left`` that have none: an extension."""
    return join(left, right, on, how="anti", nulls_equal=nulls_equal)
