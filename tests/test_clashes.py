"""Columns of the user named as helpers are, and inputs that once took another path."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import gridframe as gf
from gridframe.operators import aggregates, joins, partitioning, setops, sorting, udf
from gridframe.session import scratch_dir
from gridframe.sources import CSVReadOptions, read_csv
from tests.conftest import rows

HELPERS = ["_n", "_part", "_mid", "_p", "_o", "_c0", "_c1", "_bucket", "_bucket_r", "_ordinal", "_offset", "_k0", "_v", "_row", "ordinal", "surplus", "_lo", "_hi", "_c", "_upto", "_q", "_l0", "_r0", "p", "c", "o"]


@pytest.fixture(scope="module")
def clash(spark):
    """30 rows with a key ``k``, a value ``v`` and a column of every helper's name."""
    df = spark.range(30).select((F.col("id") % 4).alias("k"), F.col("id").alias("v"))
    return df.select("k", "v", *[(F.col("v") * 10 + i).alias(c) for i, c in enumerate(HELPERS)]).repartition(3)


def same(out, df, extra=()):
    """``out`` has all columns of ``df``, and of its rows every value as it was."""
    assert out.columns[: len(df.columns)] == df.columns and out.columns[len(df.columns) :] == list(extra)
    for r in out.collect():
        assert [r[c] for c in HELPERS] == [r.v * 10 + i for i in range(len(HELPERS))]


def test_every_operator_keeps_the_users_columns(clash):
    same(aggregates.nth(clash, "k", 1, "v"), clash)
    placed = sorting.with_ordinal(clash, "at", "v")
    same(placed, clash, ["at"])
    assert sorted((r.v, r["at"]) for r in placed.collect()) == [(i, i) for i in range(30)]
    same(sorting.slice_rows(clash, 4, 5, "v"), clash)
    same(partitioning.repartition(clash, [10, 20], by="v"), clash)
    same(partitioning.repartition_evenly(clash, 4, by="v"), clash)
    same(setops.unique(clash, "k", "first", "v"), clash)
    same(setops.concat_columns([clash, clash.select("v", F.col("k").alias("k2"))], "v").select(*clash.columns), clash)
    same(joins.range_join(clash, clash.sparkSession.range(3).selectExpr("id * 10 AS low", "id * 10 + 10 AS high"), "v", "low", "high", 10.0), clash, ["low", "high"])
    assert joins.join(clash, clash, "v", left_prefix="a_", right_prefix="b_").count() == 30
    assert setops.equals(clash, clash, ordered=True, order_a="v", order_b="v") and setops.differences(clash, clash).count() == 0
    assert dict(rows(aggregates.quantiles(clash, ["_k0"], "_v", 0.5))) == {r._k0: float(r._v) for r in clash.collect()}
    same(aggregates.rolling(clash, "k", "v", 2, "sum", "v").drop("sum_v"), clash)


def test_deep_slices_are_like_shallow_ones(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"), F.col("id").alias("_ordinal")).repartition(5)
    shallow = [tuple(r) for r in sorting.slice_rows(df, 90, 40, "x").collect()]
    monkeypatch.setattr(sorting, "DEEP", 10)
    assert [tuple(r) for r in sorting.slice_rows(df, 90, 40, "x").collect()] == shallow and len(shallow) == 40
    assert sorting.slice_rows(df, 490, 40, "x").count() == 10


def test_heavy_tails_are_narrowed(spark):
    """Log-uniform values over 18 decades: every pass leaves about a part of them, and few reach the last window."""
    df = spark.range(40_000).select((F.col("id") % 2).alias("g"), F.pow(F.lit(10.0), F.rand(3) * 18 - 9).alias("v")).persist()
    expected = {g: sorted(r.v for r in df.filter(F.col("g") == g).collect()) for g in (0, 1)}
    for q in (0.5, 0.9, 0.001):
        got = dict(rows(aggregates.quantiles(df, ["g"], "v", q, large=200)))
        for g, v in expected.items():
            n = len(v) * q
            at = [v[int(n) - 1], v[int(n)]] if n == int(n) else [v[math.floor(n)]] * 2
            assert got[g] == sum(at) / 2
    kept = df.groupBy(F.col("g").alias("_k0"), F.col("v").alias("_v")).agg(F.count("*").alias("_c"))
    ranges = df.groupBy(F.col("g").alias("_k0")).agg(F.lit(10_000).cast("long").alias("_first"), F.lit(10_001).cast("long").alias("_last")).withColumns({"_below": F.lit(0).cast("long"), "_lo": F.lit(float("-inf")), "_hi": F.lit(float("nan"))})
    once = aggregates.narrowed(kept, ranges, ["_k0"])
    assert aggregates._inside(kept, once, ["_k0"]).groupBy("_k0").count().agg(F.max("count")).first()[0] < 20_000 / 10


def test_quantiles_of_repeats_nulls_and_nan(spark):
    data = [("a", 1.0)] * 50 + [("a", 2.0)] * 50 + [("b", None)] + [("c", float("nan"))] * 3 + [("c", 5.0)] + [(None, x / 10) for x in range(99)]
    df = spark.createDataFrame(data, "g string, v double")
    for large in (0, 5, 60, 1000):
        got = {r.g: r.quantile_v for r in aggregates.quantiles(df, ["g"], "v", 0.5, large=large).collect()}
        assert (got["a"], got["b"], got[None]) == (1.5, None, 4.9) and math.isnan(got["c"])


def test_types_come_from_all_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("a"), F.when(F.col("id") > 2000, F.col("id")).alias("b")).coalesce(1)
    out = udf.infer_map(df, lambda s: s.map(lambda x: x / 2 if x == 2999 else int(x), na_action="ignore").astype(object))
    assert dict(out.dtypes) == {"a": "double", "b": "double"} and sorted(r.a for r in out.collect())[1499:1502] == [1499.0, 1499.5, 1500.0]
    assert dict(udf.apply_map(df, lambda x: None if x is None or x < 2500 else f"x{int(x)}").dtypes) == {"a": "string", "b": "string"}
    assert udf.infer_map(df.filter("false"), lambda s: s).dtypes == [("a", "string"), ("b", "string")]
    with pytest.raises(TypeError):
        udf.infer_map(df, lambda s: s.map(lambda x: "x" if x == 2500 else 1))


def test_skipped_lines_before_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'junk\na,"b,c"\n1,"x\ny"\n2,z\n')
    got = read_csv(spark, str(tmp_path / "a.csv"), CSVReadOptions(skip_rows=1, newlines_in_values=True))
    assert got.columns == ["a", "b,c"] and rows(got) == [(1, "x\ny"), (2, "z")]
    (tmp_path / "b.csv").write_bytes(b'junk,"\na,"b,c"\n1,"x,y"\n\n2,z\n')
    got = read_csv(spark, str(tmp_path / "b.csv"), CSVReadOptions(skip_rows=1))
    assert got.columns == ["a", "b,c"] and rows(got) == [(1, "x,y"), (2, "z")]
    got = read_csv(spark, str(tmp_path / "b.csv"), CSVReadOptions(skip_rows=1, use_quoting=False, newlines_in_values=True, header=False, column_names=["p", "q", "r"]))
    assert [tuple(r) for r in got.collect()] == [("a", '"b', 'c"'), ("1", '"x', 'y"'), ("2", "z", "")]
    got = read_csv(spark, str(tmp_path / "b.csv"), CSVReadOptions(skip_rows=1, use_quoting=False, header=False, column_names=["p", "q", "r"]))
    assert [tuple(r)[:2] for r in got.collect()] == [("a", '"b'), ("1", '"x'), ("2", "z")]


def test_default_joins_broadcast_a_small_side(spark):
    a, b = gf.DataFrame(spark.range(1000).selectExpr("id AS k", "id AS x")), gf.DataFrame(spark.range(5).selectExpr("id AS k", "id AS y"))
    plan = lambda f: f.to_spark()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(a.merge(b, on="k"))
    small = gf.DataFrame(spark.range(5).selectExpr("id AS k", "id AS y"))
    small.set_index("k")
    assert "BroadcastHashJoin" in plan(a.join(small, on="k"))
    assert "SortMergeJoin" in plan(a.join(small, on="k", algorithm="sort"))
    got = a.merge(b, on="k", sort=True).to_spark().collect()
    assert [r.x for r in got] == [0, 1, 2, 3, 4]


def test_group_options(spark):
    f = gf.DataFrame(spark.createDataFrame([("b", 1, 2.0), ("a", 2, None), ("b", 3, 5.0), (None, 4, 1.0), ("a", 6, 3.0)], "g string, i long, v double").coalesce(1))
    out = f.groupby("g", sort=True, dropna=True).sum()
    assert [r.g for r in out.to_spark().collect()] == ["a", "b"]
    out = f.groupby("g", as_index=True).sum()
    assert out.index.names == ["g"] and "g" not in out.columns
    labelled = f.copy() if hasattr(f, "copy") else gf.DataFrame(f.to_spark())
    labelled.set_index("g")
    assert rows(labelled.groupby(level="g").count()) == rows(f.groupby("g").count()) == rows(labelled.groupby(level=0).count())
    for bad in (lambda: f.groupby("g", unknown=1), lambda: f.sort_values("g", kind="x"), lambda: f.merge(f, on="g", copy=True)):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(ValueError):
        f.groupby()
    p = f.to_pandas()
    by = p.groupby("g", dropna=False)
    for name in ("first", "last", "prod"):
        mine, theirs = getattr(f.groupby("g"), name)(**({} if name == "prod" else {"order_by": "i"})).to_pandas(), getattr(by, name)(min_count=1) if name == "prod" else getattr(by, name)()
        mine = mine.set_index("g").sort_index()
        assert np.allclose(mine.to_numpy(dtype=float), theirs.sort_index().to_numpy(dtype=float), equal_nan=True), name
    assert rows(f.groupby("g").first()) == rows(f.groupby("g").first(order_by="i"))
    for name in ("cumsum", "cummin", "cummax", "cumprod"):
        mine = getattr(f.groupby("g"), name)(order_by="i").to_pandas()
        expected = getattr(by, name)().assign(g=p["g"])[["g", "i", "v"]]
        key = lambda d: sorted(map(repr, d.astype(object).where(d.notna(), None).apply(lambda r: (r.iloc[0], None if r.iloc[1] is None else float(r.iloc[1]), None if r.iloc[2] is None else float(r.iloc[2])), axis=1)))
        assert key(mine) == key(expected), name
    assert sorted(r.v for r in f.groupby("g").cumcount(order_by="i").to_spark().collect()) == [0, 0, 0, 1, 1]
    low = {r.g: r.v for r in f.groupby("g")["v"].idxmin("i").to_spark().collect()}
    high = {r.g: r.v for r in f.groupby("g")["v"].idxmax("i").to_spark().collect()}
    assert low == {"b": 1, "a": 6, None: 4} and high == {"b": 3, "a": 6, None: 4}


def test_metadata_file(spark, tmp_path):
    from gridframe.sources import ParquetOptions, read_parquet, write_parquet

    write_parquet(spark.range(50).repartition(3), str(tmp_path / "t"), ParquetOptions(metadata_file=True))
    import pyarrow.parquet as pq

    assert pq.read_metadata(tmp_path / "t" / "_metadata").num_rows == 50
    assert read_parquet(spark, str(tmp_path / "t" / "_metadata")).count() == 50
    with pytest.raises(ValueError):
        write_parquet(spark.range(5), str(tmp_path / "u"), ParquetOptions(metadata_file=True, chunk_size=2))


def test_row_hashes(spark):
    """The hash is Spark's xxhash64 with seed 42 of the columns in order; for one long column that is XXH64 of its 8 bytes."""
    import xxhash

    f = gf.DataFrame(spark.range(200).selectExpr("id * 1000003 AS a"))
    got = {r.a: r.hash for r in f.to_spark().select("a", F.xxhash64("a").alias("x")).join(spark.createDataFrame([], "q int"), F.lit(True), "left").select("a", F.col("x").alias("hash")).collect()}
    mine = [r.hash for r in f.get_hash_object().to_spark().collect()]
    as_signed = lambda n: n - (1 << 64) if n >> 63 else n
    assert sorted(mine) == sorted(got.values()) == sorted(as_signed(xxhash.xxh64_intdigest(int(a).to_bytes(8, "little", signed=True), 42)) for a in got)
    two = gf.DataFrame(spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "a")], "a long, b string")).get_hash_object().to_spark().collect()
    assert len({r.hash for r in two}) == 3


def test_only_one_process_may_leave_the_shared_folder_unset():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        scratch_dir(Session())


def test_pandas_input_is_whole(spark):
    assert rows(gf.DataFrame(pd.DataFrame({"a": [1, 2]}))) == [(1,), (2,)]
