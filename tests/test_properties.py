"""Random inputs against plain Python."""

from collections import Counter

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import gridframe as gf
from gridframe.operators import joins, setops, sorting
from tests.conftest import rows

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
KEY = st.one_of(st.none(), st.integers(0, 4))


@FEW
@given(st.lists(st.tuples(KEY, st.integers(0, 9)), max_size=10), st.lists(st.tuples(KEY, st.integers(0, 9)), max_size=10), st.sampled_from(["inner", "left", "right", "outer", "semi", "anti"]), st.booleans())
def test_join_cardinality(spark, a, b, how, nulls_equal):
    x, y = spark.createDataFrame(a, "k int, v int"), spark.createDataFrame(b, "k int, w int")
    same = lambda p, q: p == q and (nulls_equal or p is not None)
    pairs = [(*p, *q) for p in a for q in b if same(p[0], q[0])]
    alone = [(*p, None, None) for p in a if not any(same(p[0], q[0]) for q in b)]
    other = [(None, None, *q) for q in b if not any(same(p[0], q[0]) for p in a)]
    expected = {
        "inner": pairs, "left": pairs + alone, "right": pairs + other, "outer": pairs + alone + other,
        "semi": [p for p in a if any(same(p[0], q[0]) for q in b)], "anti": [p for p in a if not any(same(p[0], q[0]) for q in b)],
    }[how]
    got = joins.join(x, y, "k", how=how, left_prefix="l", right_prefix="r", nulls_equal=nulls_equal)
    assert Counter(tuple(r) for r in got.collect()) == Counter(expected)


@FEW
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=25), st.booleans(), st.integers(0, 30), st.integers(0, 30))
def test_sort_slice_and_tail(spark, values, up, offset, length):
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(3)
    order = sorted(values, key=lambda v: (v is None, v or 0), reverse=not up)  # nulls are the largest
    assert [r.v for r in sorting.sort(df, "v", up).collect()] == order
    assert [r.v for r in sorting.slice_rows(df, offset, length, "v", up).collect()] == order[offset : offset + length]
    assert [r.v for r in sorting.tail(df, length, "v", up).collect()] == (order[-length:] if length else [])
    assert sorted(r.o for r in sorting.with_ordinal(df, "o", "v", up).collect()) == list(range(len(values)))


@FEW
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50)), min_size=1, max_size=20), st.integers(1, 4))
def test_parts_put_together_again(spark, data, n):
    f = gf.DataFrame(pd.DataFrame(data, columns=["k", "v"]))
    parts = list(f.hash_partition("k", n).values())
    assert gf.concat(parts, ignore_index=True).equals(f, ordered=False)
    cut = len(data) // 2
    assert gf.concat([f[:cut], f[cut:]], ignore_index=True).equals(f, ordered=False)
    assert sorted(f.evenly_partition(n).row_counts_for_all()) == sorted(x for x in (len(data) // n + (i < len(data) % n) for i in range(n)) if x)


@FEW
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9)), min_size=1, max_size=20))
def test_first_and_last_of_duplicates(spark, data):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(data)], "k int, v int, i int")
    first = {k: i for i, (k, _) in reversed(list(enumerate(data)))}
    last = {k: i for i, (k, _) in enumerate(data)}
    assert {r.k: r.i for r in setops.unique(df, "k", "first", "i").collect()} == first
    assert {r.k: r.i for r in setops.unique(df, "k", "last", "i").collect()} == last
    assert len(rows(setops.unique(df, "k"))) == len(first)
