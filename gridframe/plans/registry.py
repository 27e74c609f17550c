"""``QUERIES`` (name -> function of session and folder) and ``ORACLES`` (name -> DuckDB statement with the same rows)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import gridframe as gf
from gridframe import streaming
from gridframe.operators import aggregates, joins, partitioning, relational, setops, sorting, udf
from gridframe.session import scratch_dir
from gridframe.sources import CSVReadOptions, from_arrow, from_list, from_pandas, from_pydict, read_csv, read_csv_many, read_json, read_parquet, write_csv, write_json, write_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The input tables as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_parquet(self.spark, f"{self.folder}/{name}.parquet")

    def frame(self, name: str, columns: list[str] | None = None) -> gf.DataFrame:
        df = getattr(self, name)
        return gf.DataFrame(df.select(*columns) if columns else df)

    def temporary(self, name: str) -> str:
        return f"{scratch_dir(self.spark)}/{name}-{uuid.uuid4().hex}"


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of ``Tables``."""

    def add(fn: Callable[[Tables], DataFrame | gf.DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(Tables(spark, folder))
            return out.to_spark() if isinstance(out, gf.DataFrame) else out

        key = name or fn.__name__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return fn

    return add


# --- projection, filters, predicates ---------------------------------------------------------------------------------


@query("SELECT o_orderpriority, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, round(avg(l_discount), 6) AS mean_l_discount, count(l_tax) AS cnt_l_tax FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 10 GROUP BY o_orderpriority")
def flagship_pricing(t: Tables) -> DataFrame:
    return flagship(t.spark, t.folder)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Filter, join, group and sort: what an order of each priority is worth."""
    t = Tables(spark, folder)
    items = relational.select(t.lineitem, "l_quantity > 10")
    both = joins.join(t.orders, items, "o_orderkey", "l_orderkey")
    out = aggregates.group_by(both, "o_orderpriority", {"l_extendedprice": "sum", "l_discount": "mean", "l_tax": "cnt"})
    return sorting.head(out.withColumns({"sum_l_extendedprice": F.round("sum_l_extendedprice", 2), "mean_l_discount": F.round("mean_l_discount", 6)}), 10, "o_orderpriority")


@query("SELECT l_orderkey, l_extendedprice FROM lineitem")
def project(t):
    return relational.project(t.lineitem, ["l_orderkey", "l_extendedprice"])


@query("SELECT l_shipdate, l_orderkey, l_tax FROM lineitem")
def project_positions(t):
    return relational.project(t.lineitem, [10, 0, 7])


@query("SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def select_filter(t):
    return relational.select(t.lineitem, (F.col("l_quantity") >= 45) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_quantity", "l_shipdate")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderkey % 3 = 1")
def filter_udf(t):
    return relational.select(t.orders.select("o_orderkey", "o_totalprice"), lambda p: (p.o_totalprice > 200000) & (p.o_orderkey % 3 == 1))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0")
def filter_row_predicate(t):
    return relational.select_rows(t.customer, lambda r: r["c_mktsegment"] == "BUILDING" and r["c_acctbal"] < 0).select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 700 AND NOT (o_totalprice < 100000)")
def filter_mask(t):
    f = t.frame("orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    return f[(f["o_custkey"] > 700) & ~(f["o_totalprice"] < 100000)][["o_orderkey", "o_custkey"]]


@query("SELECT CASE WHEN n_nationkey > 10 THEN n_nationkey END AS n_nationkey, CASE WHEN n_regionkey > 2 THEN n_regionkey END AS n_regionkey FROM nation")
def mask_cells(t):
    f = t.frame("nation", ["n_nationkey", "n_regionkey"])
    m = gf.DataFrame(f)
    m["n_nationkey"], m["n_regionkey"] = f["n_nationkey"] > 10, f["n_regionkey"] > 2
    return f[m]


@query("SELECT p_partkey, p_brand, p_size FROM part")
def drop_columns(t):
    return relational.drop(t.part, ["p_name", "p_type", "p_retailprice"])


@query("SELECT r_regionkey AS key, r_name AS name FROM region")
def rename_mapping(t):
    return relational.rename(t.region, {"r_regionkey": "key", "r_name": "name"})


@query("SELECT n_nationkey AS a, n_name AS b, n_regionkey AS c FROM nation")
def rename_all(t):
    return t.frame("nation").rename(["a", "b", "c"])


@query("SELECT r_regionkey AS x_r_regionkey, r_name AS x_r_name FROM region")
def add_prefix(t):
    return relational.add_prefix(t.region, "x_")


@query("SELECT r_regionkey AS r_regionkey_y, r_name AS r_name_y FROM region")
def add_suffix(t):
    return relational.add_suffix(t.region, "_y")


@query("SELECT p_partkey, round(p_retailprice * 2, 2) AS doubled, p_size FROM part")
def add_column(t):
    return relational.add_column(t.part.select("p_partkey", "p_size", "p_retailprice"), 1, "doubled", F.round(F.col("p_retailprice") * 2, 2)).drop("p_retailprice")


@query("SELECT s_suppkey, s_name, 7 AS s_nationkey, round(s_acctbal + s_suppkey, 2) AS total FROM supplier")
def set_columns(t):
    f = t.frame("supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    f["s_nationkey"] = 7
    f["total"] = f["s_acctbal"] + f["s_suppkey"]
    f["total"] = F.round(f._expr("total"), 2)
    return f[["s_suppkey", "s_name", "s_nationkey", "total"]]


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def select_dtypes(t):
    return relational.select_dtypes(t.orders, include="number")


@query("SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE 0 END AS c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END AS c_acctbal FROM customer")
def where_other(t):
    return relational.where(t.customer.select("c_custkey", "c_acctbal"), F.col("c_acctbal") > 0, 0)


@query("SELECT p_size IN (1, 5, 9) AS p_size, p_brand IN ('Brand#1', 'Brand#2') AS p_brand FROM part")
def isin_list(t):
    return relational.is_in(t.part.select("p_size", "p_brand"), [1, 5, 9, "Brand#1", "Brand#2"])


@query("SELECT p_partkey IN (1, 2, 3) AS p_partkey, false AS p_size FROM part")
def isin_dict(t):
    return relational.is_in(t.part.select("p_partkey", "p_size"), {"p_partkey": [1, 2, 3]})


@query("SELECT a.c_custkey, coalesce(a.c_nationkey = b.c_nationkey, false) AS c_nationkey, coalesce(a.c_mktsegment = b.c_mktsegment, false) AS c_mktsegment FROM customer a LEFT JOIN (SELECT o_custkey AS c_custkey, min(o_orderkey) % 25 AS c_nationkey, 'BUILDING' AS c_mktsegment FROM orders GROUP BY o_custkey) b ON a.c_custkey = b.c_custkey")
def isin_table(t):
    other = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.min("o_orderkey") % 25).alias("c_nationkey")).withColumn("c_mktsegment", F.lit("BUILDING"))
    return relational.is_in_table(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), other, "c_custkey")


for _name, _op in (("eq", "=="), ("ne", "!="), ("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">=")):
    query(f"SELECT p_partkey {_op.replace('==', '=').replace('!=', '<>')} 25 AS p_partkey, p_size {_op.replace('==', '=').replace('!=', '<>')} 25 AS p_size FROM part", f"compare_{_name}")(
        lambda t, op=_op: relational.compare(t.part.select("p_partkey", "p_size"), op, 25))


@query("SELECT (n_nationkey > 5) AND (n_regionkey < 3) AS both_, (n_nationkey > 5) OR (n_regionkey < 3) AS either, NOT (n_nationkey > 5) AS neither FROM nation")
def boolean_ops(t):
    f = t.frame("nation")
    a, b = f["n_nationkey"] > 5, f["n_regionkey"] < 3
    out = (a & b).rename(["both_"])
    out["either"], out["neither"] = a | b, ~a
    return out


_HOLES = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS cust FROM orders)"


def holes(t: Tables) -> DataFrame:
    """Orders with nulls."""
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("status"), F.when(k % 3 != 0, F.col("o_custkey")).alias("cust"))


@query(f"SELECT o_orderkey IS NULL AS o_orderkey, price IS NULL AS price, status IS NULL AS status, cust IS NULL AS cust FROM {_HOLES}")
def isnull(t):
    return relational.is_null(holes(t))


@query(f"SELECT o_orderkey IS NOT NULL AS o_orderkey, price IS NOT NULL AS price, status IS NOT NULL AS status, cust IS NOT NULL AS cust FROM {_HOLES}")
def notnull(t):
    return relational.not_null(holes(t))


@query(f"SELECT o_orderkey, coalesce(price, 0) AS price, coalesce(cust, 0) AS cust FROM {_HOLES}")
def fillna(t):
    return relational.fill_null(holes(t).drop("status"), 0)


@query(f"SELECT * FROM {_HOLES} WHERE price IS NOT NULL AND status IS NOT NULL AND cust IS NOT NULL")
def dropna_rows(t):
    return relational.drop_null(holes(t), axis=1, how="any")


@query(f"SELECT price, status, cust FROM {_HOLES} WHERE price IS NOT NULL OR status IS NOT NULL OR cust IS NOT NULL")
def dropna_rows_all(t):
    return relational.drop_null(holes(t).drop("o_orderkey"), axis=1, how="all")


@query(f"SELECT o_orderkey FROM {_HOLES}")
def dropna_columns(t):
    return relational.drop_null(holes(t), axis=0, how="any")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus FROM orders")
def astype(t):
    return relational.as_type(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), {"o_orderkey": "string", "o_custkey": float})


@query("SELECT TRY_CAST(p_name AS BIGINT) AS p_name, CAST(trunc(p_retailprice) AS BIGINT) AS p_retailprice FROM part")
def astype_unsafe(t):
    return relational.as_type(t.part.select("p_name", "p_retailprice"), "bigint", safe=False)


# --- arithmetic --------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey + 5 AS added, n_nationkey - 5 AS taken, n_nationkey * 5 AS times FROM nation")
def math_scalar(t):
    f = t.frame("nation", ["n_nationkey"])
    out = (f + 5).rename(["added"])
    out["taken"], out["times"] = f - 5, f * 5
    return out


@query("SELECT round(l_quantity + l_tax, 4) AS a, round(l_extendedprice * l_discount, 4) AS b FROM lineitem")
def math_frame(t):
    f = t.frame("lineitem", ["l_quantity", "l_extendedprice", "l_tax", "l_discount"])
    out = f[["l_quantity"]] + f[["l_tax"]]
    out.rename(["a"])
    out["b"] = f[["l_extendedprice"]] * f[["l_discount"]]
    return out.to_spark().select(F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("SELECT CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_quantity > 25 THEN 'inf' WHEN l_quantity < 25 THEN '-inf' ELSE 'nan' END ELSE 'number' END AS kind, count(*) AS n FROM lineitem GROUP BY 1")
def division_by_zero(t):
    f = gf.DataFrame(t.lineitem.select((F.col("l_quantity") - 25).alias("x"), (F.col("l_linenumber") % 3).cast("double").alias("y")))
    q = (f[["x"]] / f[["y"]]).to_spark()
    inf = float("inf")
    return q.groupBy(F.when(F.isnan("x"), "nan").when(F.col("x") == inf, "inf").when(F.col("x") == -inf, "-inf").otherwise("number").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT round(o_totalprice / 7, 6) AS o_totalprice FROM orders")
def division(t):
    return relational.each(relational.math(t.orders.select("o_totalprice"), "/", 7), lambda c, _: F.round(c, 6))


@query("SELECT -s_acctbal AS s_acctbal, -s_suppkey AS s_suppkey FROM supplier")
def negate(t):
    return relational.negate(t.supplier.select("s_acctbal", "s_suppkey"))


@query("SELECT n_name || '!' AS n_name FROM nation")
def text_concat(t):
    return t.frame("nation", ["n_name"]) + "!"


@query("SELECT n_nationkey AS key, 1 AS same_rows, 25 AS distinct_rows FROM nation")
def row_hash(t):
    """Equal rows have equal hashes wherever they lie, and the rows of this table different ones; tests have the values."""
    hashed = lambda f: f.to_spark().select(F.col("n_nationkey").cast("long").alias("key"), "hash")
    frame, turned = t.frame("nation"), gf.DataFrame(t.nation.orderBy(F.desc("n_name")))
    for f in (frame, turned):
        f["hash"] = f.get_hash_object()["hash"]
    both = hashed(frame).unionAll(hashed(turned)).groupBy("key").agg(F.count_distinct("hash").alias("same_rows"), F.min("hash").alias("hash"))
    n = both.agg(F.count_distinct("hash").cast("integer").alias("distinct_rows"))
    return both.join(n).select("key", F.col("same_rows").cast("integer").alias("same_rows"), "distinct_rows")


# --- joins ---------------------------------------------------------------------------------------------------------------

def _shifted(df: DataFrame, key: str, by: int) -> DataFrame:
    """Every row, with some keys moved to where the other side has none, so that outer joins have rows without a partner."""
    return df.withColumn(key, F.when(F.col(key) % by == 0, -F.col(key) - by).otherwise(F.col(key)))


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    for _algorithm in ("hash", "sort"):
        query(f"SELECT c_custkey, c_nationkey, o_orderkey, o_custkey FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN -c_custkey - 2 ELSE c_custkey END AS c_custkey, c_nationkey FROM customer) {_sql} (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN -o_custkey - 3 ELSE o_custkey END AS o_custkey FROM orders) ON c_custkey = o_custkey", f"join_{_how}_{_algorithm}")(
            lambda t, how=_how, algorithm=_algorithm: joins.join(_shifted(t.customer.select("c_custkey", "c_nationkey"), "c_custkey", 2), _shifted(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 3), "c_custkey", "o_custkey", how, algorithm))


@query("SELECT a.l_partkey AS a_l_partkey, a.l_suppkey AS a_l_suppkey, a.n, b.l_partkey AS b_l_partkey, b.l_suppkey AS b_l_suppkey, b.m FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) a JOIN (SELECT l_partkey, l_suppkey, count(*) AS m FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
def join_multikey_prefix(t):
    side = lambda flag, name: t.lineitem.filter(F.col("l_returnflag") == flag).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias(name))
    return joins.join(side("R", "n"), side("A", "m"), ["l_partkey", "l_suppkey"], how="inner", left_prefix="a_", right_prefix="b_")


@query("SELECT r_regionkey AS r_regionkey, r_name AS r_name_x, r.key AS key, n.name AS r_name_y FROM (SELECT r_regionkey, r_name, r_regionkey AS key FROM region) r JOIN (SELECT n_regionkey, n_name AS name FROM nation) n ON r_regionkey = n_regionkey")
def join_suffix(t):
    left = t.region.withColumn("key", F.col("r_regionkey"))
    right = t.nation.select("n_regionkey", F.col("n_name").alias("r_name"))
    return joins.join(left, right, "r_regionkey", "n_regionkey", suffixes=("_x", "_y")).drop("n_regionkey")


_NULLABLE = "(SELECT CASE WHEN n_nationkey > 3 THEN n_nationkey END AS k, n_name FROM nation)"


@query(f"SELECT a.k AS l_k, a.n_name AS l_n_name, b.k AS r_k, b.n_name AS r_n_name FROM {_NULLABLE} a JOIN {_NULLABLE} b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(t):
    a = t.nation.select(F.when(F.col("n_nationkey") > 3, F.col("n_nationkey")).alias("k"), "n_name")
    return joins.join(a, a, "k", left_prefix="l_", right_prefix="r_")


@query(f"SELECT a.k AS l_k, a.n_name AS l_n_name, b.k AS r_k, b.n_name AS r_n_name FROM {_NULLABLE} a LEFT JOIN {_NULLABLE} b ON a.k = b.k")
def join_sql_nulls(t):
    a = t.nation.select(F.when(F.col("n_nationkey") > 3, F.col("n_nationkey")).alias("k"), "n_name")
    return joins.join(a, a, "k", how="left", left_prefix="l_", right_prefix="r_", nulls_equal=False)


@query("SELECT vec_id, len(embedding) AS n, label, p_partkey, p_size FROM embeddings JOIN part ON vec_id = p_partkey")
def join_list_payload(t):
    return joins.join(t.embeddings, t.part.select("p_partkey", "p_size"), "vec_id", "p_partkey").select("vec_id", F.size("embedding").cast("long").alias("n"), "label", "p_partkey", "p_size")


@query("SELECT o_orderkey AS lo_orderkey, o_custkey, c_name FROM orders LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def frame_join(t):
    other = gf.DataFrame(t.customer.filter("c_acctbal > 0").select("c_custkey", "c_name")).set_index("c_custkey")
    out = t.frame("orders", ["o_orderkey", "o_custkey"]).join(other, on="o_custkey", how="left")
    return out.rename({"o_orderkey": "lo_orderkey"})


@query("SELECT n_nationkey AS xn_nationkey, n_name, s_suppkey, s_nationkey FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def frame_merge(t):
    out = t.frame("nation", ["n_nationkey", "n_name"]).merge(t.frame("supplier", ["s_suppkey", "s_nationkey"]), how="inner", left_on="n_nationkey", right_on="s_nationkey")
    return out.rename({"n_nationkey": "xn_nationkey"})


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_semi(t):
    return joins.join(t.customer.select("c_custkey", "c_name"), t.orders, "c_custkey", "o_custkey", "semi")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(t):
    return joins.join(t.customer.select("c_custkey", "c_name"), t.orders, "c_custkey", "o_custkey", "anti")


@query("SELECT p_partkey, low FROM part JOIN (SELECT CAST(900 + 10 * n_nationkey AS DOUBLE) AS low, CAST(905 + 12 * n_nationkey AS DOUBLE) AS high FROM nation) ON p_retailprice >= low AND p_retailprice < high")
def join_range(t):
    ranges = t.nation.select((F.lit(900.0) + 10 * F.col("n_nationkey")).alias("low"), (F.lit(905.0) + 12 * F.col("n_nationkey")).alias("high"))
    return joins.range_join(t.part.select("p_partkey", "p_retailprice"), ranges, "p_retailprice", "low", "high", 50.0).select("p_partkey", "low")


# --- grouped aggregates ---------------------------------------------------------------------------------------------------

_AGG = {"sum": "round(sum({0}), 2)", "min": "min({0})", "max": "max({0})", "cnt": "count({0})", "mean": "round(avg({0}), 6)", "var": "round(CASE WHEN count({0}) = 1 THEN 0 ELSE var_samp({0}) END, 4)", "std": "round(CASE WHEN count({0}) = 1 THEN 0 ELSE stddev_samp({0}) END, 6)", "nunique": "count(DISTINCT {0})"}
_ROUND = {"sum": 2, "mean": 6, "var": 4, "std": 6}


def _rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


for _op, _sql in _AGG.items():
    query(f"SELECT l_suppkey, {_sql.format('l_extendedprice')} AS {_op}_l_extendedprice FROM lineitem GROUP BY l_suppkey", f"groupby_{_op}")(
        lambda t, op=_op: _rounded(aggregates.group_by(t.lineitem, "l_suppkey", {"l_extendedprice": op}), **({f"{op}_l_extendedprice": _ROUND[op]} if op in _ROUND else {})))


def _type2(q: float, value: str, source: str, keys: str = "", name: str = "q") -> str:
    """DuckDB: the exact quantile with a step at every value."""
    j = f"CAST(floor(len(v) * {q} + 1e-9) AS BIGINT)"
    by = f"GROUP BY {keys}" if keys else ""
    return (f"SELECT {keys + ',' if keys else ''} CASE WHEN abs(len(v) * {q} - {j}) <= 1e-9 THEN (v[greatest({j}, 1)] + v[least(greatest({j} + 1, 1), len(v))]) / 2 ELSE v[least({j} + 1, len(v))] END AS {name} "
            f"FROM (SELECT {keys + ',' if keys else ''} list_sort(list({value})) AS v FROM {source} {by})")


for _name, _q in (("median", 0.5), ("quantile_p25", 0.25), ("quantile_p90", 0.9), ("quantile_max", 1.0)):
    query(_type2(_q, "o_totalprice", "orders", "o_custkey", "x"), f"groupby_{_name}")(
        lambda t, q=_q: aggregates.quantiles(t.orders, ["o_custkey"], "o_totalprice", q, "x"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_l_quantity, round(avg(l_extendedprice), 4) AS mean_l_extendedprice, min(l_tax) AS min_l_tax, max(l_tax) AS max_l_tax, count(l_discount) AS cnt_l_discount FROM lineitem GROUP BY ALL")
def groupby_multi(t):
    out = aggregates.group_by(t.lineitem, ["l_returnflag", "l_linestatus"], {"l_quantity": "sum", "l_extendedprice": "mean", "l_tax": ["min", "max"], "l_discount": "cnt"})
    return _rounded(out, sum_l_quantity=2, mean_l_extendedprice=4)


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice_sum, CAST(sum(o_custkey) AS BIGINT) AS o_custkey_sum FROM orders GROUP BY ALL")
def groupby_mapred(t):
    out = t.frame("orders", ["o_orderpriority", "o_totalprice", "o_custkey"]).groupby("o_orderpriority", "mapred_hash").sum().to_spark()
    return _rounded(out, o_totalprice_sum=2)


@query("SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY ALL")
def groupby_pipeline(t):
    return t.frame("orders", ["o_custkey", "o_totalprice"]).groupby(0, "pipeline").max()


@query("SELECT user_id, round(var_pop(value), 4) AS var_value, round(stddev_pop(value), 4) AS std_value FROM events GROUP BY ALL")
def groupby_ddof0(t):
    return _rounded(aggregates.group_by(t.events, "user_id", {"value": ["var", "std"]}, ddof=0), var_value=4, std_value=4)


@query(f"SELECT status, count(price) AS cnt_price, count(*) AS size_o_orderkey FROM {_HOLES} GROUP BY status")
def groupby_null_group(t):
    return aggregates.group_by(holes(t), "status", {"price": "count", "o_orderkey": "size"}).withColumnRenamed("count_price", "cnt_price")


@query(f"SELECT cust, count(*) AS size FROM {_HOLES} WHERE cust IS NOT NULL GROUP BY cust")
def groupby_dropna(t):
    return aggregates.group_by(holes(t), "cust", {}, dropna=True)


@query("SELECT c_mktsegment, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS sum_good, round(avg(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END), 6) AS mean_good FROM customer GROUP BY ALL")
def groupby_boolean(t):
    return _rounded(aggregates.group_by(t.customer.select("c_mktsegment", (F.col("c_acctbal") > 0).alias("good")), "c_mktsegment", {"good": ["sum", "mean"]}), mean_good=6)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def groupby_groups(t):
    return t.frame("lineitem").groupby(["l_returnflag", "l_linestatus"]).groups


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 2")
def group_nth(t):
    return aggregates.nth(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", 1, "o_orderkey")


@query("SELECT event_id, user_id, CASE WHEN count(value) OVER w >= 3 THEN round(avg(value) OVER w, 6) END AS mean_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling_mean(t):
    return _rounded(aggregates.rolling(t.events.select("event_id", "user_id", "value"), "user_id", "value", 3, "mean", "event_id"), mean_value=6).drop("value")


@query("SELECT event_type, round(max(value) - min(value), 4) AS spread FROM events GROUP BY ALL")
def group_apply(t):
    return udf.apply_groups(t.events.select("event_type", "value"), "event_type", lambda p: pd.DataFrame({"event_type": [p.event_type.iloc[0]], "spread": [round(p.value.max() - p.value.min(), 4)]}), "event_type string, spread double")


@query("SELECT event_type, round(max(value) - min(value), 4) AS spread FROM events GROUP BY ALL")
def group_udaf(t):
    return _rounded(udf.aggregate_udf(t.events, "event_type", "value", lambda s: float(s.max() - s.min()), "double", "spread"), spread=4)


# --- global aggregates ------------------------------------------------------------------------------------------------------


@query("SELECT round(sum(l_quantity), 2) AS sum_l_quantity, count(l_quantity) AS cnt_l_quantity, min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice, round(avg(l_tax), 6) AS mean_l_tax, round(stddev_samp(l_tax), 6) AS std_l_tax FROM lineitem")
def agg_scalar(t):
    out = aggregates.aggregate(t.lineitem, {"l_quantity": ["sum", "cnt"], "l_extendedprice": ["min", "max"], "l_tax": ["mean", "std"]})
    return _rounded(out, sum_l_quantity=2, mean_l_tax=6, std_l_tax=6)


@query("SELECT min(o_orderdate) AS min, max(o_orderdate) AS max FROM orders")
def agg_minmax(t):
    return aggregates.min_max(t.orders, "o_orderdate")


for _op in ("sum", "min", "max", "mean", "var", "std", "cnt", "nunique"):
    query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(CAST({_AGG[_op].format(c)} AS DOUBLE), 4) AS value FROM part" for c in ("p_partkey", "p_size", "p_retailprice")), f"agg_table_{_op}")(
        lambda t, op=_op: _rounded(aggregates.table_aggregate(t.part.select("p_partkey", "p_size", "p_retailprice"), op), value=4))


query(_type2(0.5, "l_extendedprice", "lineitem", "", "median_l_extendedprice"), "agg_median")(lambda t: aggregates.aggregate(t.lineitem, {"l_extendedprice": "median"}))


@query(f"SELECT CAST(NULL AS DOUBLE) AS sum_price, CAST(sum(o_orderkey) AS BIGINT) AS sum_o_orderkey, CAST(NULL AS DOUBLE) AS mean_cust FROM {_HOLES}")
def agg_keep_nulls(t):
    return aggregates.aggregate(holes(t), {"price": "sum", "o_orderkey": "sum", "cust": "mean"}, skip_nulls=False)


@query("SELECT round(product(r_regionkey + 1), 2) AS x FROM region")
def reduce_prod(t):
    return _rounded(aggregates.all_reduce(t.region.select((F.col("r_regionkey") + 1).alias("x")), "prod"), x=2)


@query("SELECT bool_and(n_nationkey >= 0) AS x FROM nation")
def reduce_land(t):
    return aggregates.all_reduce(t.nation.select((F.col("n_nationkey") >= 0).alias("x")), "land")


@query("SELECT bool_or(n_nationkey > 100) AS x FROM nation")
def reduce_lor(t):
    return aggregates.all_reduce(t.nation.select((F.col("n_nationkey") > 100).alias("x")), "lor")


@query("SELECT bit_and(o_orderkey) AS o_orderkey FROM orders")
def reduce_band(t):
    return aggregates.all_reduce(t.orders.select("o_orderkey"), "band")


@query("SELECT bit_or(o_orderkey) AS o_orderkey FROM orders")
def reduce_bor(t):
    return aggregates.all_reduce(t.orders.select("o_orderkey"), "bor")


# --- order and position --------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def sort_multi(t):
    return sorting.sort(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey", "o_totalprice"], [True, False])


@query(f"SELECT o_orderkey, price, row_number() OVER (ORDER BY price DESC NULLS FIRST, o_orderkey) - 1 AS place FROM {_HOLES}")
def sort_nulls_largest(t):
    return sorting.with_ordinal(holes(t).select("o_orderkey", "price"), "place", ["price", "o_orderkey"], [False, True])


@query(f"SELECT o_orderkey, price, row_number() OVER (ORDER BY price NULLS FIRST, o_orderkey) - 1 AS place FROM {_HOLES}")
def sort_nulls_first(t):
    return sorting.with_ordinal(holes(t).select("o_orderkey", "price"), "place", ["price", "o_orderkey"], na_position="first")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 17")
def head(t):
    return sorting.head(t.orders.select("o_orderkey", "o_orderdate"), 17, "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey DESC LIMIT 17")
def tail(t):
    return sorting.tail(t.orders.select("o_orderkey", "o_orderdate"), 17, "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 1000")
def slice_rows(t):
    return sorting.slice_rows(t.orders.select("o_orderkey", "o_custkey"), 1000, 50, "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(t):
    return sorting.top_k(t.orders.select("o_orderkey", "o_totalprice"), 25, ["o_totalprice", "o_orderkey"], [False, True])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS ordinal FROM orders")
def ordinal(t):
    return sorting.with_ordinal(t.orders.select("o_orderkey", "o_totalprice"), "ordinal", ["o_totalprice", "o_orderkey"]).drop("o_totalprice")


@query("SELECT n_nationkey AS key FROM nation UNION ALL SELECT s_suppkey FROM supplier")
def merge_sorted(t):
    return sorting.merge_sorted([t.nation.select(F.col("n_nationkey").cast("long").alias("key")), t.supplier.select(F.col("s_suppkey").alias("key"))], "key")


# --- sets, duplicates, concatenation ----------------------------------------------------------------------------------------------

_A, _B = "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return tuple(t.lineitem.filter(F.col("l_returnflag") == f).select("l_partkey", "l_suppkey") for f in "RA")


query(f"{_A} UNION {_B}", "union")(lambda t: setops.union(*_sides(t)))
query(f"{_A} EXCEPT {_B}", "subtract")(lambda t: setops.subtract(*_sides(t)))
query(f"{_A} INTERSECT {_B}", "intersect")(lambda t: setops.intersect(*_sides(t)))
query(f"{_A} UNION ALL {_B}", "union_all")(lambda t: setops.union_all(_sides(t)))
query(f"{_A} EXCEPT {_B}", "set_difference")(lambda t: setops.set_difference(*_sides(t), ["l_partkey", "l_suppkey"]))
query(f"{_A} INTERSECT {_B}", "set_intersect")(lambda t: setops.set_intersect(*_sides(t), ["l_partkey", "l_suppkey"]))
query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'R')", "set_union")(lambda t: setops.set_union(*_sides(t), "l_partkey").select("l_partkey"))


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def unique_any(t):
    return setops.unique(t.orders.select("o_custkey", "o_orderpriority"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def unique_first(t):
    return setops.unique(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "first", "o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def unique_last(t):
    return setops.unique(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "last", "o_orderkey")


@query("SELECT true AS same, false AS other, true AS ordered")
def equals(t):
    a = t.nation
    rows = [(setops.equals(a, a.orderBy(F.desc("n_name"))), setops.equals(a, a.filter("n_nationkey <> 3")), setops.equals(a, a, ordered=True))]
    return t.spark.createDataFrame(rows, "same boolean, other boolean, ordered boolean")


@query("SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN n ELSE -n END AS surplus FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL)")
def differences(t):
    keys = t.orders.select("o_custkey")
    return setops.differences(keys.filter("o_custkey % 2 = 0"), keys.filter("o_custkey % 2 = 1"))


@query("SELECT p_partkey, p_name, p_size, p_size_1 FROM part JOIN (SELECT p_partkey + 100 AS k, p_size AS p_size_1 FROM part) ON p_partkey = k")
def concat_columns(t):
    return setops.concat_columns([t.part.select("p_partkey", "p_name", "p_size"), t.part.select((F.col("p_partkey") + 100).alias("p_partkey"), "p_size")], "p_partkey")


@query("SELECT n_nationkey, n_name, s_suppkey FROM (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS j FROM supplier) ON i = j")
def concat_positions(t):
    return gf.concat([t.frame("nation", ["n_nationkey", "n_name"]).sort_values("n_nationkey"), t.frame("supplier", ["s_suppkey"]).sort_values("s_suppkey")], axis=1)


@query("SELECT * FROM region UNION ALL SELECT * FROM region")
def concat_rows(t):
    return gf.concat([t.frame("region"), t.frame("region")])


# --- labels -------------------------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 220")
def loc_range(t):
    return t.frame("orders", ["o_orderkey", "o_custkey", "o_totalprice"]).sort_values("o_orderkey").set_index("o_orderkey").loc[100:220]


@query("SELECT n_regionkey FROM nation WHERE n_name IN ('NATION_3', 'NATION_7', 'NATION_11')")
def loc_labels(t):
    return t.frame("nation").set_index("n_name").loc[["NATION_7", "NATION_3", "NATION_11"], "n_regionkey"]


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey >= 10 AND p_partkey < 30")
def iloc_range(t):
    return t.frame("part").sort_values("p_partkey").iloc[10:30, 0:2]


@query("SELECT p_partkey FROM part WHERE p_partkey IN (0, 5, 17)")
def iloc_list(t):
    return t.frame("part").sort_values("p_partkey").iloc[[5, 0, 17], [0]]


@query('SELECT n_name AS "index", n_nationkey, n_regionkey FROM nation')
def reset_index(t):
    return t.frame("nation").set_index("n_name").reset_index()


# --- where rows lie --------------------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL")
def shuffle(t):
    return partitioning.shuffle(t.orders, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS keys FROM orders")
def hash_partition(t):
    parts = partitioning.hash_partition(t.orders.select("o_custkey"), "o_custkey", 4)
    counted = [p.agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("keys")) for p in parts.values()]
    return setops.union_all(counted).agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"))  # keys do not straddle parts


@query("SELECT count(*) AS n FROM orders")
def range_partition(t):
    return partitioning.range_partition(t.orders, "o_totalprice", 4).agg(F.count("*").alias("n"))


@query("SELECT CAST(p AS INTEGER) AS partition, CAST(n AS BIGINT) AS rows FROM (VALUES (0, 5), (1, 10), (2, 7), (3, 3)) v(p, n)")
def repartition_exact(t):
    return partitioning.row_counts(partitioning.repartition(t.nation, [5, 10, 7, 3], "n_nationkey"))


@query("SELECT CAST(p AS INTEGER) AS partition, (SELECT count(*) FROM orders) // 4 + CASE WHEN p < (SELECT count(*) FROM orders) % 4 THEN 1 ELSE 0 END AS rows FROM range(4) r(p)")
def repartition_evenly(t):
    return partitioning.row_counts(partitioning.repartition_evenly(t.orders, 4, "o_orderkey"))


@query("SELECT count(*) AS n FROM supplier")
def round_robin(t):
    return partitioning.round_robin(t.supplier, 3).agg(F.count("*").alias("n"))


@query("SELECT CAST(0 AS INTEGER) AS partition, count(*) AS rows FROM supplier")
def gather(t):
    return partitioning.row_counts(partitioning.gather(t.supplier))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def broadcast_join(t):
    return joins.join(t.nation, partitioning.all_gather(t.region), "n_regionkey", "r_regionkey").select("n_name", "r_name")


# --- user functions -----------------------------------------------------------------------------------------------------------------------


@query("SELECT 'x' || n_name AS n_name, 'x' || CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def applymap(t):
    return udf.apply_map(t.nation.select("n_name", "n_regionkey"), lambda v: f"x{v}", "string")


@query("SELECT s_acctbal * 2 AS s_acctbal FROM supplier")
def infer_map(t):
    return udf.infer_map(t.supplier.select("s_acctbal"), lambda s: s * 2)


# --- sources and sinks ---------------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def csv_round_trip(t):
    write_csv(t.nation, path := t.temporary("csv"))
    return read_csv(t.spark, path)


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS name FROM nation")
def csv_options(t):
    held = t.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("na"))
    write_csv(held, path := t.temporary("csv"))
    opts = CSVReadOptions(header=False, column_names=["k", "name"], skip_rows=1, column_types={"k": "bigint"}).na_values(["na"])
    return read_csv(t.spark, path, opts)


@query("SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
def csv_many(t):
    paths = [t.temporary("csv") for _ in range(2)]
    for p in paths:
        write_csv(t.region, p)
    return setops.union_all(read_csv_many(t.spark, paths)).select("r_name")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def json_round_trip(t):
    write_json(t.supplier, path := t.temporary("json"))
    return read_json(t.spark, path).select("s_suppkey", "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"), "s_acctbal")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def parquet_round_trip(t):
    write_parquet(t.orders, path := t.temporary("parquet"))
    return read_parquet(t.spark, path, ["o_orderkey", "o_totalprice"])


@query("SELECT n_nationkey, n_name FROM nation")
def arrow_round_trip(t):
    return from_arrow(t.spark, t.nation.select("n_nationkey", "n_name").toArrow())


@query("SELECT r_regionkey, r_name FROM region")
def pandas_round_trip(t):
    return from_pandas(t.spark, t.region.toPandas())


@query("SELECT CAST(a AS BIGINT) AS a, b FROM (VALUES (1, 'x'), (2, 'y')) v(a, b)")
def from_dict(t):
    return from_pydict(t.spark, {"a": [1, 2], "b": ["x", "y"]})


@query('SELECT CAST(a AS BIGINT) AS "0", CAST(b AS BIGINT) AS "1" FROM (VALUES (1, 4), (2, 5), (3, 6)) v(a, b)')
def from_columns(t):
    return from_list(t.spark, [[1, 2, 3], [4, 5, 6]])


# --- streaming ---------------------------------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, event_type, count(value) AS cnt_value, round(max(value), 4) AS max_value FROM events GROUP BY ALL")
def stream_windows(t):
    held = t.temporary("stream")
    write_parquet(t.events.repartition(3), held)
    events = streaming.files(t.spark, held, t.events.schema)
    name = f"windows_{uuid.uuid4().hex}"
    streaming.into_table(streaming.windowed(events, "ts", "1 hour", ["event_type"], {"value": "cnt"}, "1 hour"), name + "_c", t.temporary("ck"), "complete").awaitTermination()
    streaming.into_table(streaming.windowed(events, "ts", "1 hour", ["event_type"], {"value": "max"}, "1 hour"), name + "_m", t.temporary("ck"), "complete").awaitTermination()
    out = aggregates._on_keys(t.spark.table(name + "_c"), t.spark.table(name + "_m"), ["window_start", "window_end", "event_type"])
    return out.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "window_end": F.col("window_end").cast("timestamp_ntz"), "max_value": F.round("max_value", 4)})


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_pieces(t):
    held, out = t.temporary("stream"), t.temporary("pieces")
    write_parquet(t.events.repartition(3), held)
    count = lambda piece, _: piece.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("append").parquet(out)
    streaming.each_piece(streaming.files(t.spark, held, t.events.schema), count, t.temporary("ck")).awaitTermination()
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"))
