"""The table names of the frame."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import gridframe as gf
from tests.conftest import rows


@pytest.fixture
def pair(spark):
    a = gf.Table.from_pydict(None, {"a": [1, 2, 3, 2], "b": [4, 5, 6, 7]})
    return a, gf.Table.from_list(None, ["a", "c"], [[2, 3, 9], [7, 8, 9]])


def test_constructors(spark):
    assert rows(gf.Table.from_numpy(None, ["x"], [np.array([1, 2])])) == [(1,), (2,)]
    assert rows(gf.Table.from_arrow(gf.Env(config=object()), pa.table({"x": [1]}))) == [(1,)]
    assert gf.Table.from_pandas(None, pd.DataFrame({"x": [1]}, index=[7]), preserve_index=True).columns == ["index", "x"]


def test_joins_by_name_and_position(pair):
    a, b = pair
    out = a.join(b, "inner", "hash", on=["a"], left_prefix="l_", right_prefix="r_")
    assert out.columns == ["l_a", "b", "r_a", "c"] and rows(out) == [(2, 5, 2, 7), (2, 7, 2, 7), (3, 6, 3, 8)]
    out = a.distributed_join(b, "outer", "sort", left_on=[0], right_on=[0])
    assert out.columns == ["a", "b", "a_1", "c"] and len(out) == 5
    with pytest.raises(ValueError):
        a.join(b, "inner")


def test_groupby_sort_and_sets(pair):
    a, b = pair
    assert rows(a.groupby("a", {"b": ["sum", "max"]})) == [(1, 4, 4), (2, 12, 7), (3, 6, 6)]
    assert a.groupby(0).sum().columns == ["a", "sum_b"]
    assert a.distributed_sort("b", False, gf.SortOptions(sampling="initial")).to_pandas().b.tolist() == [7, 6, 5, 4]
    assert len(a.distributed_union(a)) == 4 and len(a.distributed_unique(["a"])) == 3
    assert a.distributed_equals(a) and a.sum("b").to_pandas().iloc[0, 0] == 22
    assert len(gf.Table.merge_all([a, a])) == 8 and len(gf.Table.concat([a, a])) == 8
    assert a.project([1]).columns == ["b"]
