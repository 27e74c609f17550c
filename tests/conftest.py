import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    built = SparkSession.builder.master("local[4]").appName("tests")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    conf["spark.checkpoint.dir"] = f"file://{tmp_path_factory.mktemp('shared')}"
    for k, v in conf.items():
        built = built.config(k, v)
    session = built.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/sf0.001/{t}.parquet')")
    return con


def cells(pdf):
    """Rows as sorted tuples of comparable text; numbers by value, nulls alike."""

    def one(v):
        if v is None or str(v) in ("<NA>", "nan", "NaT"):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        try:
            return repr(float(v))
        except (TypeError, ValueError):
            return str(v)

    cols = sorted(pdf.columns)
    return cols, sorted(tuple(map(one, r)) for r in pdf[cols].astype(object).itertuples(index=False))


def rows(df):
    """Rows of a Spark or library frame as sorted tuples."""
    df = df.to_spark() if hasattr(df, "to_spark") else df
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])
