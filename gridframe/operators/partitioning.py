"""Where rows lie: shuffles, partitions by hash or range, exact row counts, gathering."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.operators.columns import Key, col, fresh, names_of
from gridframe.operators.sorting import with_ordinal


def _parallelism(df: DataFrame, n: int | None) -> int:
    return n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shuffle(df: DataFrame, columns: Key | Sequence[Key], n: int | None = None) -> DataFrame:
    """Rows with equal values in the columns in one partition."""
    return df.repartition(_parallelism(df, n), *[col(c) for c in names_of(df, columns)])


def hash_id(columns: Sequence[str], n: int) -> Column:
    """A row's partition among ``n``."""
    return F.pmod(F.hash(*[col(c) for c in columns]), F.lit(n))


def hash_partition(df: DataFrame, columns: Key | Sequence[Key], n: int) -> dict[int, DataFrame]:
    """Frames by partition number; together they have the rows of ``df``, and equal keys are in one of them."""
    return split(df, hash_id(names_of(df, columns), n), n)


def split(df: DataFrame, by: Column, n: int) -> dict[int, DataFrame]:
    """Frames by the value 0 to n-1 of ``by``."""
    return {i: df.filter(by == i) for i in range(n)}


def range_partition(df: DataFrame, columns: Key | Sequence[Key], n: int | None = None, ascending: bool = True) -> DataFrame:
    """Partitions that each hold a range of the order of the columns."""
    cols = [col(c) for c in names_of(df, columns)]
    return df.repartitionByRange(_parallelism(df, n), *[c.asc_nulls_last() if ascending else c.desc_nulls_first() for c in cols])


def repartition(df: DataFrame, rows: Sequence[int] | Mapping[int, int], by: Key | Sequence[Key] | None = None, receive_order: Sequence[int] | None = None) -> DataFrame:
    """Partition i gets exactly ``rows[i]`` rows, the order of the source (or of ``by``) kept throughout.

    Rows are handed out to partitions 0, 1, 2 ... or in ``receive_order``.  ValueError if that is no order of all
    partitions, or if the sum is not the number of rows, which is checked at once.
    """
    counts = [rows[i] for i in range(len(rows))]
    order = list(range(len(counts))) if receive_order is None else list(receive_order)
    if sorted(order) != list(range(len(counts))):
        raise ValueError(f"{order} is no order of {len(counts)} partitions")
    name = fresh(df, "_ordinal")
    placed = with_ordinal(df, name, by)
    if (total := placed.count()) != sum(counts):
        raise ValueError(f"{sum(counts)} rows asked for, {total} there")
    ends = list(itertools.accumulate(counts[i] for i in order))
    turn = F.array_size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= col(name)))
    target = F.get(F.array(*[F.lit(i) for i in order]), turn)
    # repartitionById puts rows exactly where the number says
    return placed.repartitionById(len(counts), target.cast("int")).sortWithinPartitions(col(name)).drop(name)


def repartition_evenly(df: DataFrame, n: int, by: Key | Sequence[Key] | None = None) -> DataFrame:
    """``n`` partitions whose row counts differ by one at most, the larger ones first, order kept."""
    name = fresh(df, "_ordinal")
    placed = with_ordinal(df, name, by)
    size, larger = divmod(placed.count(), n)
    at, ahead = col(name), larger * (size + 1)
    target = F.when(at < ahead, F.floor(at / (size + 1))).otherwise(larger + F.floor((at - ahead) / max(size, 1)))
    return placed.repartitionById(n, target.cast("int")).sortWithinPartitions(at).drop(name)


def round_robin(df: DataFrame, n: int) -> DataFrame:
    """``n`` partitions of about equal size, without an order."""
    return df.repartition(n)


def gather(df: DataFrame) -> DataFrame:
    """All rows in one partition: only for frames that one task can hold."""
    return df.coalesce(1)


#: Bytes beyond which a frame is not broadcast.
BROADCAST = 64 << 20


def all_gather(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """``df`` marked to be sent whole to every executor, if the optimizer's estimate of its size is at most ``most`` bytes; else ``df`` as it is, which joins by a shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


broadcast = all_gather


def row_counts(df: DataFrame) -> DataFrame:
    """``partition``, ``rows`` for each partition that has rows."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))
