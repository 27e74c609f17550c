"""Set operations, duplicates, concatenation and equality. Null equals null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.operators.columns import Key, col, fresh, names_of
from gridframe.operators.joins import anti_join, semi_join


def _same_schema(a: DataFrame, b: DataFrame) -> None:
    if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
        raise ValueError(f"schemas differ: {a.schema.simpleString()} and {b.schema.simpleString()}")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    _same_schema(a, b)
    return a.union(b).distinct()


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` lacks."""
    _same_schema(a, b)
    return a.subtract(b)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both sides."""
    _same_schema(a, b)
    return a.intersect(b)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames with one schema; ValueError for none."""
    if not parts:
        raise ValueError("nothing to merge")
    for p in parts[1:]:
        _same_schema(parts[0], p)
    return reduce(DataFrame.unionAll, parts)


def unique(df: DataFrame, subset: Key | Sequence[Key] | None = None, keep: str = "any", order_by: Key | Sequence[Key] | None = None) -> DataFrame:
    """One row for each value of ``subset``: any, or the first or last in the order of ``order_by``.

    First and last are aggregates of whole rows (``min_by``, ``max_by``), which are partly done before the shuffle; the
    order should be total, since ties have no defined winner.
    """
    keys = names_of(df, subset)
    if keep == "any" or set(keys) == set(df.columns):
        return df.dropDuplicates(keys)
    if keep not in ("first", "last") or order_by is None:
        raise ValueError("keep='first' or 'last' needs order_by")
    order = F.struct(*[x for c in names_of(df, order_by) for x in (col(c).isNull(), col(c))])  # nulls are the largest
    row = F.struct(*[col(c) for c in df.columns])
    ks = [col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    out = df.groupBy(*ks).agg((F.min_by if keep == "first" else F.max_by)(row, order).alias("_row"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])


def set_union(a: DataFrame, b: DataFrame, subset: Key | Sequence[Key] | None = None) -> DataFrame:
    """One row of both for each value of ``subset``."""
    return unique(union_all([a, b]), subset)


def set_difference(a: DataFrame, b: DataFrame, subset: Key | Sequence[Key] | None = None) -> DataFrame:
    """Rows of ``a``, one for each value of ``subset``, whose value ``b`` lacks."""
    keys = names_of(a, subset)
    return unique(anti_join(a, b, keys), keys)


def set_intersect(a: DataFrame, b: DataFrame, subset: Key | Sequence[Key] | None = None) -> DataFrame:
    """Rows of ``a``, one for each value of ``subset``, whose value ``b`` has."""
    keys = names_of(a, subset)
    return unique(semi_join(a, b, keys), keys)


def concat_columns(parts: Sequence[DataFrame], on: Key | Sequence[Key], how: str = "inner") -> DataFrame:
    """Frames side by side, rows with the same label in one row; ``on`` names the label in each, kept once, first.

    Other names that repeat are marked with their frame's number.
    """
    if not parts:
        raise ValueError("nothing to concatenate")
    keys = names_of(parts[0], on)
    seen = set(parts[0].columns)
    out = parts[0]
    for n, p in enumerate(parts[1:], 1):
        new = {c: c if c not in seen else f"{c}_{n}" for c in p.columns if c not in keys}
        seen |= set(new.values())
        mark = "_c"
        while any(c.startswith(mark) for c in (*seen, *p.columns)):
            mark += "_"
        p = p.select(*[col(k).alias(f"{mark}{i}") for i, k in enumerate(names_of(p, list(keys)))], *[col(c).alias(x) for c, x in new.items()])
        cond = reduce(lambda x, y: x & y, [col(k).eqNullSafe(F.col(f"{mark}{i}")) for i, k in enumerate(keys)])
        both = out.join(p, cond, {"outer": "full"}.get(how, how))
        ks = [F.coalesce(col(k), F.col(f"{mark}{i}")).alias(k) for i, k in enumerate(keys)]
        out = both.select(*ks, *[col(c) for c in out.columns if c not in keys], *[col(x) for x in new.values()])
    return out


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that the two have in different numbers, with ``surplus``, by how many ``a`` has more; one aggregation, no join."""
    name = fresh(a, "surplus")
    sides = a.withColumn(name, F.lit(1)).unionAll(b.withColumn(name, F.lit(-1)))
    return sides.groupBy(*[col(c) for c in a.columns]).agg(F.sum(name).alias(name)).filter(col(name) != 0)


def equals(a: DataFrame, b: DataFrame, ordered: bool = False, order_a: Key | Sequence[Key] | None = None, order_b: Key | Sequence[Key] | None = None) -> bool:
    """Do both have the same rows equally often, and with ``ordered`` in the same places?  Runs at once.

    Places are those of the source, or of a stated order.  Frames with other schemas are not equal.
    """
    if [f.dataType for f in a.schema] != [f.dataType for f in b.schema] or a.columns != b.columns:
        return False
    if ordered:
        from gridframe.operators.sorting import with_ordinal

        name = fresh(a, "ordinal")
        a, b = with_ordinal(a, name, order_a), with_ordinal(b, name, order_b)
    return differences(a, b).isEmpty()
