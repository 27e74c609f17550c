"""Grouped and global aggregates.

Sums widen to long or double; groups without values give null; one value has variance 0; means are doubles; boolean
columns count as 0 and 1; dates and times have only min, max, count and nunique.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridframe.operators.columns import Key, col, fresh, names_of
from gridframe.session import stored

OPS = ("sum", "min", "max", "cnt", "count", "mean", "var", "std", "nunique", "median", "quantile", "size", "prod")
_ALIAS = {"count": "cnt", "avg": "mean", "stddev": "std", "variance": "var"}


def _number(df: DataFrame, name: str, op: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return col(name).cast("long")
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"{op} of column {name} of {kind.simpleString()}")
    return col(name)


def _variance(c: Column, ddof: int) -> Column:
    n = F.count(c)
    if ddof == 0:
        return F.var_pop(c)
    if ddof == 1:
        return F.when(n == 1, F.lit(0.0)).otherwise(F.var_samp(c))
    return F.when(n == 1, F.lit(0.0)).when(n > ddof, F.var_pop(c) * n / (n - ddof))


def expression(df: DataFrame, name: str, op: str, ddof: int = 1) -> Column:
    """The aggregate of a column; ``quantile`` and ``median`` are not one expression (see ``quantiles``)."""
    op = _ALIAS.get(op, op)
    c = col(name)
    if op in ("min", "max"):
        return F.min(c) if op == "min" else F.max(c)
    if op == "cnt":
        return F.count(c)
    if op == "size":
        return F.count("*")
    if op == "nunique":
        return F.count_distinct(c)
    x = _number(df, name, op)
    if op == "sum":
        return F.sum(x)
    if op == "mean":
        return F.avg(x)
    if op == "prod":
        return F.product(x)
    if op == "var":
        return _variance(x, ddof)
    if op == "std":
        return F.sqrt(_variance(x, ddof))
    raise ValueError(f"unknown aggregate {op!r}")


def _pairs(df: DataFrame, spec: Mapping[Key, str | Sequence[str]]) -> list[tuple[str, str]]:
    return [(names_of(df, k)[0], op) for k, ops in spec.items() for op in ([ops] if isinstance(ops, str) else ops)]


def group_by(df: DataFrame, keys: Key | Sequence[Key], spec: Mapping[Key, str | Sequence[str]], naming: str = "prefix", ddof: int = 1, q: float = 0.5, dropna: bool = False) -> DataFrame:
    """Key columns, then one column for each aggregate, named ``op_column`` (``column_op`` or ``column`` by ``naming``).

    Null keys are one group unless ``dropna``.  Catalyst adds up within partitions before the shuffle for all of these but
    the quantiles, which take the passes of ``quantiles``.
    """
    keys = names_of(df, keys)
    pairs = _pairs(df, spec)
    name = {"prefix": lambda c, op: f"{op}_{c}", "suffix": lambda c, op: f"{c}_{op}", "plain": lambda c, op: c}[naming]
    if dropna:
        df = df.dropna(subset=keys)
    plain = [(c, op) for c, op in pairs if op not in ("quantile", "median")]
    parts = []
    if plain or not pairs:
        parts.append(df.groupBy(*[col(k) for k in keys]).agg(*[expression(df, c, op, ddof).alias(name(c, op)) for c, op in plain] or [F.count("*").alias("size")]))
    parts += [quantiles(df, keys, c, 0.5 if op == "median" else q, name(c, op)) for c, op in pairs if op in ("quantile", "median")]
    out = reduce(lambda a, b: _on_keys(a, b, keys), parts)
    return out.select(*[col(k) for k in keys], *([col(name(c, op)) for c, op in pairs] or [F.col("size")]))


def _on_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both of one row a group, joined on the group."""
    b = b.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    cond = reduce(lambda x, y: x & y, [col(k).eqNullSafe(col(f"_k_{k}")) for k in keys]) if keys else F.lit(True)
    return a.join(b, cond).drop(*[f"_k_{k}" for k in keys])


#: From how many values on a group's range is narrowed before they are run through in order, into how many parts, and the
#: accuracy of the sketch that places the cuts.
LARGE, PARTS, ACCURACY = 1_000_000, 64, 1_000


def quantiles(df: DataFrame, keys: Sequence[str], value: str, q: float = 0.5, name: str | None = None, large: int | None = None) -> DataFrame:
    """The exact q-quantile of each group, with a step at every value and the mean of both neighbours where it falls between (Hyndman and Fan's type 2); null for groups without values.

    With n values, j = floor(nq) and g = nq - j, it is the (j+1)-th smallest, or its mean with the j-th if g is 0.  Values
    are counted, partially before the shuffle, and the distinct ones are run through in order.  A task does that for a
    group of at most ``large`` values; of larger groups the distinct values and their counts are stored once, and ``narrowed``
    until a range of at most ``large`` distinct values is left.  NaN is greater than every number.
    """
    if not 0 <= q <= 1:
        raise ValueError(f"quantile {q}")
    name, keys, large = name or f"quantile_{value}", list(keys), LARGE if large is None else large
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[col(k).alias(n) for k, n in zip(keys, ks, strict=True)], _number(df, value, "quantile").cast("double").alias("_v"))
    ends = lambda out: out.select(*[F.col(x).alias(k) for x, k in zip(ks, keys, strict=True)], col(name))
    counted = lambda r: r.groupBy(*ks, "_v").agg(F.count("*").alias("_c"))
    # a count of the whole table, often known to the source, tells whether any group can be large
    if rows.count() <= large:
        return ends(_run_through(counted(rows), ks, q, name))
    big = stored(rows.filter("_v IS NOT NULL").groupBy(*ks).agg(F.count("*").alias("_n")).filter(F.col("_n") > large), "quantile-groups")
    if big.isEmpty():
        return ends(_run_through(counted(rows), ks, q, name))
    of_big = _same_group(ks)
    kept = stored(counted(rows.filter("_v IS NOT NULL").join(big.toDF(*[f"s{k}" for k in ks], "_n"), of_big, "left_semi")), "quantile-values")
    n = F.col("_n") * F.lit(float(q))
    whole = F.floor(n + 1e-9)
    low, high = F.greatest(whole, F.lit(1)), F.least(F.greatest(whole + 1, F.lit(1)), F.col("_n"))
    state = {"_first": F.when(F.abs(n - whole) <= 1e-9, low).otherwise(high), "_last": high, "_below": F.lit(0).cast("long"), "_lo": F.lit(float("-inf")), "_hi": F.lit(float("nan"))}
    ranges = big.withColumns(state).drop("_n")
    most = None
    while True:
        ranges = stored(ranges, "quantile-ranges")
        left = _inside(kept, ranges, ks)
        now = left.groupBy(*ks).count().agg(F.max("count")).first()[0]
        if now <= max(large, 2) or now == most:
            break
        most, ranges = now, narrowed(kept, ranges, ks)
    exact = left.withColumn("_upto", F.col("_below") + F.sum("_c").over(Window.partitionBy(*ks).orderBy("_v")))
    at = lambda x: F.min(F.when(F.col("_upto") >= F.col(x), F.col("_v")))
    out = exact.groupBy(*ks).agg(((at("_first") + at("_last")) / 2).alias(name))
    if ks:
        out = out.unionByName(_run_through(counted(rows.join(big.toDF(*[f"s{k}" for k in ks], "_n"), of_big, "left_anti")), ks, q, name))
    return ends(out)


def _same_group(ks: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in ks], F.lit(True))


def _run_through(counts: DataFrame, ks: Sequence[str], q: float, name: str) -> DataFrame:
    """The quantile of groups whose distinct values a task can hold, by one run through them in order."""
    own = Window.partitionBy(*ks)
    real = F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(0)
    counts = counts.withColumns({"_upto": F.sum(real).over(own.orderBy(F.col("_v").asc_nulls_first())), "_n": F.sum(real).over(own)})
    n = F.col("_n") * F.lit(float(q))
    whole = F.floor(n + 1e-9)
    low, high = F.greatest(whole, F.lit(1)), F.least(F.greatest(whole + 1, F.lit(1)), F.col("_n"))
    at = lambda x: F.min(F.when(F.col("_upto") >= x, F.col("_v")))
    return counts.groupBy(*ks).agg(((at(F.when(F.abs(n - whole) <= 1e-9, low).otherwise(high)) + at(high)) / 2).alias(name))


def _inside(kept: DataFrame, ranges: DataFrame, ks: Sequence[str]) -> DataFrame:
    """Counted values with the state of their group, if they lie in its range."""
    s = ranges.withColumnsRenamed({k: f"s{k}" for k in ks})
    return kept.join(s, _same_group(ks)).filter("_v >= _lo AND _v <= _hi").drop(*[f"s{k}" for k in ks])


def narrowed(kept: DataFrame, ranges: DataFrame, ks: Sequence[str]) -> DataFrame:
    """Ranges of about a ``PARTS``-th of the distinct values, whatever their distribution, that hold the same ranks.

    A sketch of a group's distinct values, merged between partitions, places the cuts; the counts between them are exact, so
    the sketch only balances the parts.
    """
    left = _inside(kept, ranges, ks)
    marks = F.percentile_approx("_v", [i / PARTS for i in range(PARTS + 1)], ACCURACY)
    cuts = stored(left.groupBy(*ks).agg(F.array_distinct(marks).alias("_cuts")).toDF(*[f"s{k}" for k in ks], "_cuts"), "quantile-cuts")
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    parts = left.join(cuts, _same_group(ks)).groupBy(*ks, part.alias("_part")).agg(F.sum("_c").alias("_c"), F.min("_v").alias("_plo"), F.max("_v").alias("_phi"), *[F.first(x).alias(x) for x in ("_first", "_last", "_below")])
    parts = parts.withColumn("_upto", F.col("_below") + F.sum("_c").over(Window.partitionBy(*ks).orderBy("_part"))).withColumn("_from", F.col("_upto") - F.col("_c"))
    hit = parts.filter((F.col("_upto") >= F.col("_first")) & (F.col("_from") < F.col("_last")))
    return hit.groupBy(*ks).agg(*[F.first(x).alias(x) for x in ("_first", "_last")], F.min("_from").alias("_below"), F.min("_plo").alias("_lo"), F.max("_phi").alias("_hi"))


def aggregate(df: DataFrame, spec: Mapping[Key, str | Sequence[str]], ddof: int = 1, skip_nulls: bool = True, q: float = 0.5) -> DataFrame:
    """One row with ``op_column`` for each aggregate; without ``skip_nulls`` a column with a null gives null."""
    pairs = _pairs(df, spec)
    exprs = []
    for c, op in pairs:
        if op in ("quantile", "median"):
            continue
        e = expression(df, c, op, ddof)
        if not skip_nulls and op not in ("cnt", "count", "size", "nunique"):
            e = F.when(F.count("*") == F.count(col(c)), e)
        exprs.append(e.alias(f"{op}_{c}"))
    parts = ([df.agg(*exprs)] if exprs else []) + [quantiles(df, [], c, 0.5 if op == "median" else q, f"{op}_{c}") for c, op in pairs if op in ("quantile", "median")]
    return reduce(lambda a, b: a.crossJoin(b), parts).select(*[col(f"{op}_{c}") for c, op in pairs])  # one row each


def min_max(df: DataFrame, column: Key) -> DataFrame:
    """``min`` and ``max`` of a column."""
    c = col(names_of(df, column)[0])
    return df.agg(F.min(c).alias("min"), F.max(c).alias("max"))


def table_aggregate(df: DataFrame, op: str, ddof: int = 1, skip_nulls: bool = True, columns: Sequence[Key] | None = None) -> DataFrame:
    """A row for each column: its name, and its aggregate as a double."""
    names = names_of(df, columns)
    one = aggregate(df, {c: op for c in names}, ddof, skip_nulls)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(f"{op}_{c}").cast("double").alias("value")) for c in names]))
    return one.select(cells.alias("x")).select("x.column", "x.value")


#: Reductions of a column over all its rows, by the usual names of collective operations.
REDUCE = {"sum": F.sum, "min": F.min, "max": F.max, "prod": F.product, "land": F.bool_and, "lor": F.bool_or, "band": F.bit_and, "bor": F.bit_or}


def all_reduce(df: DataFrame, op: str, columns: Key | Sequence[Key] | None = None) -> DataFrame:
    """One row with the reduction of each column, names kept."""
    if op.lower() not in REDUCE:
        raise ValueError(f"unknown reduction {op!r}")
    return df.agg(*[REDUCE[op.lower()](col(c)).alias(c) for c in names_of(df, columns)])


def nth(df: DataFrame, keys: Key | Sequence[Key], n: int, order_by: Key | Sequence[Key]) -> DataFrame:
    """The n-th row of each group (0 is the first, -1 the last) in a stated order; groups with fewer rows have none."""
    ks, os = [col(k) for k in names_of(df, keys)], [col(k) for k in names_of(df, order_by)]
    order = [o.asc_nulls_last() for o in os] if n >= 0 else [o.desc_nulls_first() for o in os]
    at = n + 1 if n >= 0 else -n
    name = fresh(df, "_n")
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*ks).orderBy(*order))).filter(F.col(name) == at).select(*[col(c) for c in df.columns])


def _order(order_by: Sequence[str]) -> Column:
    """One value that orders rows by columns; nulls are the largest."""
    return F.struct(*[x for c in order_by for x in (col(c).isNull(), col(c))])


def ends(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order_by: Sequence[str], last: bool) -> DataFrame:
    """The first or last value of each column that is not null, by group; null for a column without values."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(*[col(k) for k in keys]).agg(*[pick(col(c), F.when(col(c).isNotNull(), _order(order_by))).alias(c) for c in columns])


def labels_of(df: DataFrame, keys: Sequence[str], columns: Sequence[str], label: Key, largest: bool) -> DataFrame:
    """By group, the ``label`` of the row with each column's smallest or largest value; of equals the smallest label."""
    name = names_of(df, label)[0]
    out = []
    for c in columns:
        if c != name:
            top = F.max(col(c)) if largest else F.min(col(c))
            out.append((c, top))
    tops = df.groupBy(*[col(k).alias(f"_k_{i}") for i, k in enumerate(keys)]).agg(*[t.alias(f"_t_{i}") for i, (_, t) in enumerate(out)])
    rows = df.select(*[col(k).alias(f"_r_{i}") for i, k in enumerate(keys)], *[col(c).alias(f"_v_{i}") for i, (c, _) in enumerate(out)], col(name).alias("_label"))
    same = reduce(lambda x, y: x & y, [F.col(f"_k_{i}").eqNullSafe(F.col(f"_r_{i}")) for i in range(len(keys))])
    found = rows.join(tops, same).groupBy(*[f"_r_{i}" for i in range(len(keys))]).agg(*[F.min(F.when(F.col(f"_v_{i}") == F.col(f"_t_{i}"), F.col("_label"))).alias(c) for i, (c, _) in enumerate(out)])
    return found.select(*[F.col(f"_r_{i}").alias(k) for i, k in enumerate(keys)], *[col(c) for c, _ in out])


def running(df: DataFrame, keys: Sequence[str], columns: Sequence[str], op: str, order_by: Sequence[str], dropna: bool = False) -> DataFrame:
    """Every row with each column replaced by its aggregate over the group's rows up to this one; null where the value is null. ``count`` numbers rows from 0.

    A group is run through in one task, spilling to disk.
    """
    if dropna:
        df = df.dropna(subset=list(keys))
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(_order(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    fn = {"sum": F.sum, "min": F.min, "max": F.max, "prod": F.product}.get(op)
    cell = lambda c: F.count(F.lit(1)).over(w) - 1 if fn is None else F.when(col(c).isNotNull(), fn(col(c)).over(w))
    return df.select(*[cell(c).alias(c) if c in columns else col(c) for c in df.columns])


def rolling(df: DataFrame, keys: Key | Sequence[Key], value: Key, window: int, op: str, order_by: Key | Sequence[Key], min_periods: int | None = None) -> DataFrame:
    """``df`` with ``op_value``: the aggregate of the last ``window`` rows of the group, null before there are ``min_periods``."""
    v = names_of(df, value)[0]
    w = Window.partitionBy(*[col(k) for k in names_of(df, keys)]).orderBy(*[col(k).asc_nulls_last() for k in names_of(df, order_by)]).rowsBetween(-(window - 1), 0)
    fn = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp}[op]
    return df.withColumn(f"{op}_{v}", F.when(F.count(col(v)).over(w) >= (window if min_periods is None else min_periods), fn(col(v)).over(w)))
