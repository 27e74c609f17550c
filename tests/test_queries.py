"""Every registered query against its DuckDB statement, on the smallest tables."""

import pytest

from gridframe import plans
from tests.conftest import DATA, cells


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    if name not in plans.ORACLES:
        assert len(got)
        return
    assert cells(got) == cells(duck.execute(plans.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["o_orderpriority", "sum_l_extendedprice", "mean_l_discount", "cnt_l_tax"]
    assert 0 < out.count() <= 10
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(plans.QUERIES) <= set(e.queries())


def test_filter_and_columns_reach_the_scan(spark):
    plan = plans.QUERIES["select_filter"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,45.0)" in plan.replace(" ", "") and "l_extendedprice" not in plan


def test_no_cartesian_products(spark):
    for name, q in plans.QUERIES.items():
        if name.startswith("join_"):
            assert "CartesianProduct" not in q(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString(), name
