"""Operators on small literals: nulls, ties, names, empty inputs, and algebraic properties."""

import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridframe.operators import aggregates, joins, partitioning, relational, setops, sorting, udf
from tests.conftest import rows


def test_null_keys_join_by_rule(spark):
    a = spark.createDataFrame([(None, 1), (2, 3)], "k int, v int")
    b = spark.createDataFrame([(None, 5)], "k int, v int")
    for how in ("inner", "left", "right", "outer"):
        for algorithm in (None, "hash", "sort"):
            out = joins.join(a, b, "k", how=how, algorithm=algorithm, left_prefix="l_", right_prefix="r_")
            assert (None, 1, None, 5) in rows(out), (how, algorithm)
            assert out.columns == ["l_k", "l_v", "r_k", "r_v"]
    assert rows(joins.join(a, b, "k", left_prefix="l", nulls_equal=False)) == []


def test_join_keeps_unique_names_and_repeats_others(spark):
    a = spark.createDataFrame([(1, 2, 3)], "k int, v int, w int")
    b = spark.createDataFrame([(1, 7)], "k int, v int")
    out = joins.join(a, b, "k")
    assert out.columns == ["k", "v", "w", "k", "v"]
    assert rows(relational.project(out, [4, 0])) == [(7, 1)]
    assert joins.join(a, b, "k", suffixes=("_x", "_y")).columns == ["k_x", "v_x", "w", "k_y", "v_y"]
    with pytest.raises(ValueError):
        joins.join(a, b, "k", how="cross")
    with pytest.raises(KeyError):
        joins.join(a, b, "nope")


def test_join_algorithm_hints(spark):
    a = spark.range(1000).toDF("k")
    for algorithm, node in (("hash", "ShuffledHashJoin"), ("sort", "SortMergeJoin")):
        for how in ("inner", "left", "right", "outer"):
            assert node in joins.join(a, a, "k", how=how, algorithm=algorithm, left_prefix="l")._jdf.queryExecution().executedPlan().toString()


def test_grouped_edge_cases(spark):
    df = spark.createDataFrame([("a", None, -1.5), ("a", None, -2.5), ("b", 4, -3.0), ("c", 1, 1.0), ("c", 2, 2.0), (None, 5, 0.0), (None, 6, 0.0)], "g string, i int, x double")
    got = {r.g: r for r in aggregates.group_by(df, "g", {"i": ["sum", "min", "max", "mean", "cnt", "var", "nunique"], "x": ["max", "var", "std"]}).collect()}
    assert (got["a"].sum_i, got["a"].min_i, got["a"].mean_i, got["a"].cnt_i) == (None, None, None, 0)
    assert got["a"].max_x == -1.5 and got["b"].var_i == 0 and got["b"].std_x == 0
    assert got["c"].mean_i == 1.5 and got[None].sum_i == 11
    assert aggregates.group_by(df, "g", {"i": "sum"}, dropna=True).count() == 3
    with pytest.raises(TypeError):
        aggregates.group_by(df.withColumn("d", F.current_date()), "g", {"d": "sum"})
    assert aggregates.group_by(df, "g", {"i": "sum"}, naming="suffix").columns == ["g", "i_sum"]
    assert aggregates.group_by(df, "g", {"i": "sum"}, naming="plain").columns == ["g", "i"]


@pytest.mark.parametrize(("q", "expected"), [(0.25, 2.0), (0.2, 1.5), (1.0, 9.0), (0.0, 0.0), (0.5, 4.5)])
def test_quantile_of_ten_values(spark, q, expected):
    df = spark.range(10).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    assert rows(aggregates.quantiles(df, ["g"], "v", q)) == [("g", expected)]
    assert aggregates.quantiles(df, [], "v", q).first()[0] == expected


def test_quantile_with_nan_and_without_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 2.0)], "g string, v double")
    for large in (0, 100):
        assert rows(aggregates.quantiles(df, ["g"], "v", 0.5, large=large)) == [("a", 2.0)]
        assert math.isnan(aggregates.quantiles(df, [], "v", 1.0, large=large).first()[0])
        assert aggregates.quantiles(df.filter("false"), [], "v", large=large).collect()[0][0] is None
        assert aggregates.quantiles(df.filter("false"), ["g"], "v", large=large).count() == 0


def _type2(values, q):
    v = sorted(values)
    n = len(v) * q
    j = math.floor(n + 1e-9)
    if abs(n - j) <= 1e-9:
        return (v[max(j, 1) - 1] + v[min(max(j + 1, 1), len(v)) - 1]) / 2
    return float(v[min(j + 1, len(v)) - 1])


def test_quantile_of_odd_groups(spark):
    groups = {"ties": [5.0] * 9, "wide": [-1e300, 0.0, 1e300, 2.0], "one": [3.0], "near": [1.0, 1.0 + 1e-12, 1.0 + 2e-12], "skewed": [0.0] * 50 + [1e9] + [float(i) for i in range(40)], "inf": [float("-inf"), 1.0, 2.0, float("inf")]}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v] + [("none", None), (None, 1.0), (None, 2.0)], "g string, v double")
    for q, large in ((0.1, 0), (0.5, 0), (0.75, 0), (0.5, 20), (0.75, 1000)):
        got = dict(rows(aggregates.quantiles(df, ["g"], "v", q, large=large)))
        assert got.pop("none") is None
        assert got.pop(None) == _type2([1.0, 2.0], q)
        assert got == {g: _type2(v, q) for g, v in groups.items()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(-50, 50))), min_size=1, max_size=40), st.sampled_from([0.3, 0.5, 0.9]))
def test_quantile_matches_sorting(spark, data, q):
    df = spark.createDataFrame(data, "g int, v int")
    got = dict(rows(aggregates.quantiles(df, ["g"], "v", q, large=len(data) // 4)))
    for g in {g for g, _ in data}:
        own = [v for h, v in data if h == g and v is not None]
        assert got[g] == (_type2(own, q) if own else None)


def test_global_aggregates(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (4, 3.0)], "a int, b double")
    assert tuple(aggregates.aggregate(df, {"a": ["sum", "mean"], "b": ["cnt", "sum"]}).first()) == (7, 7 / 3, 2, 4.0)
    assert tuple(aggregates.aggregate(df, {"a": "sum", "b": "sum"}, skip_nulls=False).first()) == (7, None)
    assert dict(rows(aggregates.table_aggregate(df, "max"))) == {"a": 4.0, "b": 3.0}
    assert aggregates.min_max(df, "a").first() == (1, 4)
    empty = df.filter("a > 10")
    assert tuple(aggregates.aggregate(empty, {"a": ["sum", "cnt"], "b": "median"}).select("sum_a", "cnt_a").first()) == (None, 0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(*[st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.integers(0, 2)), max_size=12)] * 2)
def test_set_algebra(spark, a, b):
    x, y = (spark.createDataFrame(v, "p int, q int") for v in (a, b))
    assert rows(setops.union(x, y)) == rows(spark.createDataFrame(list(set(a) | set(b)), "p int, q int"))
    assert rows(setops.subtract(x, y)) == rows(spark.createDataFrame(list(set(a) - set(b)), "p int, q int"))
    assert rows(setops.intersect(x, y)) == rows(spark.createDataFrame(list(set(a) & set(b)), "p int, q int"))
    assert setops.equals(x, y) == (sorted(map(str, a)) == sorted(map(str, b)))
    assert len(rows(setops.set_difference(x, y, "p"))) == len({p for p, _ in a} - {p for p, _ in b})


def test_unique_keeps_first_or_last_with_null_keys(spark):
    df = spark.createDataFrame([(1, 1, 0), (None, 2, 1), (1, 3, 2), (None, 5, 3), (3, None, 4)], "a int, b int, o int")
    assert rows(setops.unique(df, "a", "last", "o").select("a", "b")) == [(1, 3), (3, None), (None, 5)]
    assert rows(setops.unique(df, "a", "first", "o").select("a", "b")) == [(1, 1), (3, None), (None, 2)]


def test_schemas_must_match(spark):
    a, b = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x",)], "a string")
    for op in (setops.union, setops.subtract, setops.intersect):
        with pytest.raises(ValueError):
            op(a, b)
    with pytest.raises(ValueError):
        setops.union_all([])
    assert not setops.equals(a, b)


def test_ordered_equality(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "a int")
    b = spark.createDataFrame([(2,), (1,), (2,)], "a int")
    assert setops.equals(a, b) and not setops.equals(a, b, ordered=True)
    assert setops.equals(a, b, ordered=True, order_a="a", order_b="a")


def test_sorting_and_slices(spark):
    df = spark.createDataFrame([(3, "c"), (None, "n"), (1, "a"), (2, "b")], "k int, v string").repartition(3)
    assert [r.v for r in sorting.sort(df, "k").collect()] == ["a", "b", "c", "n"]
    assert [r.v for r in sorting.sort(df, "k", False).collect()] == ["n", "c", "b", "a"]
    assert [r.v for r in sorting.tail(df, 2, "k").collect()] == ["c", "n"]
    assert [r.v for r in sorting.slice_rows(df, 1, 2, "k").collect()] == ["b", "c"]
    assert sorting.slice_rows(df, 3, 9, "k").count() == 1
    for bad in (lambda: sorting.head(df, -1), lambda: sorting.tail(df, -1, "k"), lambda: sorting.slice_rows(df, -1, 2)):
        with pytest.raises(ValueError):
            bad()


def test_ordinals_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    got = sorting.with_ordinal(df, "o", "k").collect()
    assert all(r.k == r.o for r in got) and len(got) == 1000


def test_exact_repartition(spark):
    df = spark.range(17).toDF("k").repartition(3)
    out = partitioning.repartition(df, [3, 0, 10, 4], "k")
    parts = out.withColumn("p", F.spark_partition_id()).collect()
    assert [[r.k for r in parts if r.p == i] for i in range(4)] == [list(range(3)), [], list(range(3, 13)), list(range(13, 17))]
    assert sorted(r.rows for r in partitioning.row_counts(partitioning.repartition_evenly(df, 4, "k")).collect()) == [4, 4, 4, 5]
    with pytest.raises(ValueError):
        partitioning.repartition(df, [1, 2])


def test_exact_repartition_in_another_order(spark):
    df = spark.range(10).toDF("k")
    parts = partitioning.repartition(df, [2, 3, 5], "k", receive_order=[2, 0, 1]).withColumn("p", F.spark_partition_id()).collect()
    assert [sorted(r.k for r in parts if r.p == i) for i in range(3)] == [[5, 6], [7, 8, 9], [0, 1, 2, 3, 4]]
    with pytest.raises(ValueError):
        partitioning.repartition(df, [5, 5], receive_order=[0, 0])


def test_partitions_split_keys(spark):
    df = spark.range(200).select((F.col("id") % 13).alias("k"))
    parts = partitioning.hash_partition(df, "k", 5)
    assert sum(p.count() for p in parts.values()) == 200
    seen = [{r.k for r in p.distinct().collect()} for p in parts.values()]
    assert sum(map(len, seen)) == len(set().union(*seen)) == 13


def test_division_is_ieee(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 4.0), (None, 1.0), (float("nan"), 0.0)], "a double, b double")
    from gridframe.functions import divide

    got = [r[0] for r in df.select(divide(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [float("inf"), float("-inf")] and math.isnan(got[2]) and got[3] == 1.5 and got[4] is None and math.isnan(got[5])


def test_nulls_and_casts(spark):
    df = spark.createDataFrame([(1, None, 1.5), (None, "x", float("nan"))], "a int, b string, c double")
    assert rows(relational.is_null(df)) == [(False, True, False), (True, False, True)]
    assert relational.drop_null(df, axis=1, how="any").count() == 0
    assert relational.drop_null(df.select("c"), axis=0).columns == []
    with pytest.raises(TypeError):
        relational.fill_null(df, "text")
    assert relational.as_type(df.select("c").limit(1), "bigint", safe=False).first()[0] == 1
    with pytest.raises(Exception, match="fraction"):
        relational.as_type(df.select("c").limit(1), "bigint").collect()
    with pytest.raises(ValueError):
        relational.as_type(df, "no such type")
    with pytest.raises(ValueError):
        relational.invert(df)
    with pytest.raises(ValueError):
        relational.select_dtypes(df)
    assert relational.select_dtypes(df, include="number").columns == ["a", "c"]
    assert relational.select_dtypes(df, exclude="float64").columns == ["a", "b"]


def test_isin_with_nulls(spark):
    df = spark.createDataFrame([(2, "falcon"), (4, None)], "legs int, name string")
    assert rows(relational.is_in(df, [2, None])) == [(False, False), (True, False)]
    assert rows(relational.is_in(df, [None], skip_null=False)) == [(False, False), (False, True)]
    assert rows(relational.is_in(df, {"legs": [4]})) == [(False, False), (True, False)]


def test_user_functions(spark):
    df = spark.createDataFrame([("Rayan", "Cameron"), ("Jack", None)], "c1 string, c2 string")
    assert rows(udf.apply_map(df, lambda v: None if v is None else v.upper())) == [("JACK", None), ("RAYAN", "CAMERON")]
    num = spark.createDataFrame([(1, 2.0), (3, 4.0)], "a int, b double")
    assert rows(udf.infer_map(num, lambda s: s * 2)) == [(2, 4.0), (6, 8.0)]
    out = udf.apply_groups(num.withColumn("g", F.lit(1)), "g", lambda p: pd.DataFrame({"n": [len(p)]}), "n long")
    assert rows(out) == [(2,)]


def test_renaming_rules(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        relational.rename(df, {"x": "y"})
    with pytest.raises(ValueError):
        relational.rename(df, ["x"])
    with pytest.raises(IndexError):
        relational.project(df, [5])
    with pytest.raises(KeyError):
        relational.drop(df, "x")


def test_concat_columns_by_label(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert rows(setops.concat_columns([a, b], "k", "outer")) == [(1, "x", None), (2, "y", "z"), (3, None, "w")]


def test_range_join(spark):
    a = spark.createDataFrame([(float(i),) for i in range(20)], "v double")
    b = spark.createDataFrame([(0.0, 5.0), (4.0, 12.5), (7.0, 7.0)], "lo double, hi double")
    got = rows(joins.range_join(a, b, "v", "lo", "hi", 3.0))
    assert got == sorted((float(v), lo, hi) for v in range(20) for lo, hi in ((0.0, 5.0), (4.0, 12.5)) if lo <= v < hi)
