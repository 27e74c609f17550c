"""The frame against pandas."""

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import gridframe as gf
from tests.conftest import rows


@pytest.fixture
def data(spark):
    return pd.DataFrame({"a": [3, 1, 2, 1], "b": [1.5, -2.0, 0.0, 4.0], "c": ["x", "y", "z", "x"]})


def same(frame, expected):
    got = frame.to_pandas()
    assert list(got.columns) == list(expected.columns)
    pd.testing.assert_frame_equal(got.reset_index(drop=True), expected.reset_index(drop=True), check_dtype=False)


def test_constructors(spark):
    assert rows(gf.DataFrame([[1, 2], [3, 4]])) == [(1, 3), (2, 4)]
    assert gf.DataFrame([[1, 2], [3, 4]]).columns == ["0", "1"]
    assert rows(gf.DataFrame([1, 2])) == [(1,), (2,)]
    assert gf.DataFrame([np.array([1, 2]), np.array([3, 4])], columns=["p", "q"]).columns == ["p", "q"]
    assert rows(gf.DataFrame({"a": [1]})) == [(1,)]
    assert rows(gf.DataFrame(gf.Series("s", [5, 6]))) == [(5,), (6,)]
    assert gf.DataFrame([]).shape == (0, 0)
    with pytest.raises(ValueError):
        gf.DataFrame([[1, 2], [3]])


def test_arrow_types(spark):
    t = pa.table({"u8": pa.array([1, 255], pa.uint8()), "u64": pa.array([1, 2**64 - 1], pa.uint64()), "h": pa.array(np.array([1, 2], np.float16)), "t": pa.array([1, 2], pa.time32("s")), "l": pa.array([[1, 2], None], pa.list_(pa.int32())), "d": pa.array(["x", "y"]).dictionary_encode()})
    f = gf.DataFrame(t)
    assert f.dtypes == {"u8": "smallint", "u64": "decimal(20,0)", "h": "float", "t": "time(6)", "l": "array<int>", "d": "string"}
    assert int(f.to_spark().select("u64").collect()[1][0]) == 2**64 - 1


def test_cells(data):
    f = gf.DataFrame(data)
    n = f[["a", "b"]]
    same(n + 1, data[["a", "b"]] + 1)
    same(n * n, data[["a", "b"]] * data[["a", "b"]])
    same(n - 2, data[["a", "b"]] - 2)
    same(-n, -data[["a", "b"]])
    same(n > 1, data[["a", "b"]] > 1)
    same(f[f["a"] > 1], data[data.a > 1])
    same(f[(f["a"] == 1) & ~(f["c"] == "x")], data[(data.a == 1) & (data.c != "x")])
    same(n.where(n > 1, 0), data[["a", "b"]].where(data[["a", "b"]] > 1, 0))
    same(f["c"] + "!", data[["c"]] + "!")
    same(f[1:3], data[1:3])
    same(f[2], data[2:3])
    with pytest.raises(ValueError):
        ~f["a"]
    with pytest.raises(KeyError):
        f["nope"]


def test_a_mask_is_a_filter_not_a_join(data):
    f = gf.DataFrame(data)
    assert "Join" not in f[(f["a"] > 1) & (f["b"] < 9)].to_spark()._jdf.queryExecution().executedPlan().toString()


def test_assignment(data):
    f = gf.DataFrame(data)
    f["d"] = f["a"] * 2
    f["a"] = 0
    f["e"] = [9, 8, 7, 6]
    f["g"] = gf.DataFrame({"x": [1, 2, 3, 4]})
    f.add_column(1, "k", 5)
    expected = data.assign(d=data.a * 2, a=0, e=[9, 8, 7, 6], g=[1, 2, 3, 4])
    expected.insert(1, "k", 5)
    got = f.to_pandas().sort_values("g")
    pd.testing.assert_frame_equal(got.reset_index(drop=True), expected, check_dtype=False)
    with pytest.raises(ValueError):
        f["z"] = [1, 2]


def test_names(data):
    f = gf.DataFrame(data)
    assert f.add_prefix("p_").columns == ["p_a", "p_b", "p_c"]
    assert f.add_suffix("_s").columns == ["a_s", "b_s", "c_s"]
    assert f.drop(["b"]).columns == ["a", "c"]
    assert f.rename({"a": "z"}).columns == ["z", "b", "c"]
    assert f.select_dtypes("number").columns == ["z", "b"]
    with pytest.raises(ValueError):
        f.rename({"nope": "x"})


def test_nulls(spark):
    pdf = pd.DataFrame({"a": [1.0, None, 3.0], "b": [None, None, 6.0]})
    f = gf.DataFrame(pdf)
    same(f.isnull(), pdf.isnull())
    same(f.notna(), pdf.notna())
    same(f.fillna(0), pdf.fillna(0))
    for how in ("any", "all"):
        same(f.dropna(axis=1, how=how), pdf.dropna(axis=0, how=how))
        assert f.dropna(axis=0, how=how).columns == list(pdf.dropna(axis=1, how=how).columns)


def test_labels(data):
    pdf = data.assign(k=[10, 20, 30, 40]).set_index("k")
    f = gf.DataFrame(data.assign(k=[10, 20, 30, 40])).set_index("k")
    same(f.loc[20:30], pdf.loc[20:30])
    same(f.loc[20:40, "a":"b"], pdf.loc[20:40, "a":"b"])
    same(f.loc[[40, 10]], pdf.loc[[40, 10]])
    same(f.loc[30], pdf.loc[[30]])
    same(f.iloc[1:3], pdf.iloc[1:3])
    same(f.iloc[0], pdf.iloc[[0]])
    same(f.iloc[[2, 0], [1, 0]], pdf.iloc[[2, 0], [1, 0]])
    same(f.iloc[1:], pdf.iloc[1:])
    same(f.iloc[-2:], pdf.iloc[-2:])
    assert f.index.values.tolist() == [10, 20, 30, 40] and f.index.isin([20]) == [False, True, False, False]
    assert list(f.to_pandas().index) == [10, 20, 30, 40]
    assert [(k, v[0]) for k, v in f.iterrows()] == [(10, 3), (20, 1), (30, 2), (40, 1)]
    assert f.reset_index().columns == ["index", "a", "b", "c"]
    dup = gf.DataFrame(data).set_index("a")
    with pytest.raises(IndexError):
        dup.loc[1:2]
    with pytest.raises(KeyError):
        dup.loc[77:]
    lab = gf.DataFrame(data).set_index(["p", "q", "r", "s"])
    assert sorted(lab.index.values.tolist()) == ["p", "q", "r", "s"]


def test_isin(spark):
    f = gf.DataFrame({"legs": [2, 4], "wings": [2, 0]})
    same(f.isin([0, 2]), f.to_pandas().isin([0, 2]))
    same(f.isin({"wings": [0, 3]}), f.to_pandas().isin({"wings": [0, 3]}))
    other = gf.DataFrame({"legs": [8, 4], "wings": [2, 2]})
    got = f.isin(other).to_pandas()
    assert sorted(map(tuple, got.to_numpy().tolist())) == [(False, True), (True, False)]


def test_merge_and_join(spark):
    a, b = pd.DataFrame({"k": [1, 2, 3], "v": [4, 5, 6]}), pd.DataFrame({"k": [2, 3, 3], "w": [7, 8, 9]})
    for how in ("inner", "left", "right", "outer"):
        for algorithm in ("hash", "sort"):
            got = gf.DataFrame(a).merge(gf.DataFrame(b), how=how, on="k", algorithm=algorithm)
            assert got.columns == ["_xk", "v", "_yk", "w"]
            assert len(got) == len(a.merge(b, how=how, on="k"))
    got = gf.DataFrame(a).join(gf.DataFrame(b).set_index("k"), on="k", how="inner")
    assert sorted(map(tuple, got.to_pandas().to_numpy().tolist())) == [(2, 5, 7), (3, 6, 8), (3, 6, 9)]
    with pytest.raises(ValueError):
        gf.DataFrame(a).join(gf.DataFrame(b))


def test_groupby(data):
    g = gf.DataFrame(data[["a", "b"]]).groupby("a")
    for op in ("sum", "min", "max", "mean", "count", "std"):
        got = getattr(g, op)().to_pandas().sort_values("a")
        expected = getattr(data[["a", "b"]].groupby("a"), op)().reset_index()
        np.testing.assert_allclose(got.iloc[:, 1].astype(float), expected.b.fillna(0).astype(float))
    assert rows(g.size()) == [(1, 2), (2, 1), (3, 1)]
    assert sorted((k, len(f)) for k, f in g) == [(1, 2), (2, 1), (3, 1)]
    assert g.agg({"b": ["sum", "max"]}).columns == ["a", "sum_b", "max_b"]
    with pytest.raises(AttributeError):
        g.nonsense()


def test_reductions(data):
    f = gf.DataFrame(data[["a", "b"]])
    for op in ("sum", "min", "max", "mean", "var", "std"):
        np.testing.assert_allclose(np.array(getattr(f, op)().to_pandas().iloc[0], float), getattr(data[["a", "b"]], op)())
    assert f.shape == (4, 2) and f.median().to_pandas().iloc[0, 0] == 1.5 and f.nunique().to_pandas().iloc[0, 0] == 3


def test_duplicates_and_sets(data):
    f = gf.DataFrame(data)
    assert sorted(f.drop_duplicates("c", keep="first").to_pandas().a) == [1, 2, 3]
    assert sorted(f.drop_duplicates("c", keep="last").to_pandas().b) == [-2.0, 0.0, 4.0]
    assert f.union(f).equals(f, ordered=False) and len(f.subtract(f)) == 0 and f.intersect(f).equals(f, ordered=False)
    assert f.equals(gf.DataFrame(data)) and not f.equals(gf.DataFrame(data[::-1]))
    assert len(gf.concat([f, f])) == 8
    side = gf.concat([f[["a"]], gf.DataFrame({"z": [1, 2, 3, 4]})], axis=1)
    assert sorted(map(tuple, side.to_pandas().to_numpy().tolist())) == [(1, 2), (1, 4), (2, 3), (3, 1)]


def test_positions_and_partitions(data):
    f = gf.DataFrame(data)
    same(f.head(2), data.head(2))
    same(f.tail(2), data.tail(2))
    assert f.repartition([1, 3]).row_counts_for_all() == [1, 3]
    assert f.evenly_partition(2).row_counts_for_all() == [2, 2]
    assert sum(f.shuffle("a").row_counts_for_all()) == 4
    same(f.sort_values(["a", "b"], ascending=[True, False]), data.sort_values(["a", "b"], ascending=[True, False]))


def test_files(data, tmp_path):
    f = gf.DataFrame(data)
    f.to_csv(str(tmp_path / "c"))
    f.to_parquet(str(tmp_path / "p"))
    f.to_json(str(tmp_path / "j"))
    for g in (gf.read_csv(str(tmp_path / "c")), gf.read_parquet(str(tmp_path / "p")), gf.read_json(str(tmp_path / "j"))):
        assert g.equals(f, ordered=False), g


def test_named_files(data, tmp_path):
    f = gf.DataFrame(data).repartition([1, 3])
    f.to_csv(str(tmp_path / "c"), name_function=lambda i: f"piece_{i}.csv")
    assert sorted(p.name for p in (tmp_path / "c").glob("*.csv")) == ["piece_0.csv", "piece_1.csv"]
    assert gf.read_csv(str(tmp_path / "c")).equals(gf.DataFrame(data), ordered=False)
    assert len(gf.read_csv(str(tmp_path / "c" / "piece_1.csv"))) == 3
    with pytest.raises(ValueError):
        f.to_parquet(str(tmp_path / "p"), name_function=lambda i: "same")


def test_csv_settings(spark, tmp_path):
    from gridframe.sources import CSVReadOptions, read_csv

    (tmp_path / "a.csv").write_text("note\n\na;b;c\n1;na;yes\n2;none;no\n\n3;x;yes\n")
    o = CSVReadOptions(delimiter=";", skip_rows=2, true_values=["yes"], false_values=["no"]).na_values(["na", "none"])
    assert rows(read_csv(spark, str(tmp_path / "a.csv"), o)) == [(1, None, True), (2, None, False), (3, "x", True)]
    (tmp_path / "b.csv").write_text('1,"x, ""y""",2.5\n2,z,\n')
    o = CSVReadOptions().auto_generate_column_names()
    got = read_csv(spark, str(tmp_path / "b.csv"), o)
    assert got.columns == ["0", "1", "2"] and rows(got) == [(1, 'x, "y"', 2.5), (2, "z", None)]
    o = CSVReadOptions(header=False, column_names=["p", "q", "r"], include_columns=["r", "p", "s"], include_missing_columns=True)
    assert read_csv(spark, str(tmp_path / "b.csv"), o).columns == ["r", "p", "s"]
    with pytest.raises(KeyError):
        read_csv(spark, str(tmp_path / "b.csv"), CSVReadOptions(include_columns=["nope"]))
    (tmp_path / "d.csv").write_text("a,b\n1,2\n")
    (tmp_path / "e.csv").write_text("a,b\n1,x\n")
    with pytest.raises(ValueError):
        gf.read_csv_dist([str(tmp_path / "d.csv"), str(tmp_path / "e.csv")])
    assert len(gf.read_csv_dist({0: str(tmp_path / "d.csv"), 1: [str(tmp_path / "d.csv")]})) == 2


def test_discard_takes_away_what_was_stored(spark):
    from gridframe.session import _written, stored

    kept = stored(gf.DataFrame({"a": [1]}).to_spark(), "x")
    assert kept.count() == 1 and _written
    path = _written[-1].removeprefix("file://")
    gf.discard(spark)
    assert not _written and not os.path.exists(path)


def test_env_and_conveniences(data):
    env = gf.Env()
    assert env.rank == 0 and env.world_size >= 1
    env.barrier()
    f = gf.DataFrame(data)
    f.register("t")
    assert gf.view("t").equals(f, ordered=False)
    assert "x" in f.to_string() and f.is_cpu() and f.to_table() is f
    same(f.astype({"a": float}), data.astype({"a": float}))
    same(f[["c"]].applymap(str.upper), data[["c"]].map(str.upper))
    f.retain_memory()
    f.retain_memory(False)
    assert f.filter("a > 1").filter(lambda p: p.b > 0).to_pandas().a.tolist() == [3]
