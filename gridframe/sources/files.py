"""CSV, Parquet and JSON files; a path may be one, several, a pattern, or a mapping from ranks to paths."""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridframe.functions.types import resolve_type
from gridframe.operators.columns import col
from gridframe.sources.options import CSVReadOptions

Paths = str | Sequence[str] | Mapping[int, str | Sequence[str]]


def listed(paths: Paths) -> list[str]:
    """Paths in order; those of a mapping in the order of its ranks."""
    if isinstance(paths, str):
        return [paths]
    if isinstance(paths, Mapping):
        return [p for r in sorted(paths) for p in listed(paths[r])]
    return [str(p) for p in paths]


def _same(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        if f.dtypes != out.dtypes:
            raise ValueError(f"schemas differ: {out.schema.simpleString()} and {f.schema.simpleString()}")
        out = out.unionAll(f)
    return out


def read_csv(spark: SparkSession, paths: Paths, options: CSVReadOptions | None = None, check_schema: bool = False) -> DataFrame:
    """Rows of all files; types are those given, or inferred over all rows in one pass.

    A column is the first of long, double, boolean, timestamp and string that all its values fit.  ``check_schema`` reads
    and compares file by file.
    """
    o = options or CSVReadOptions()
    own = listed(paths)
    if check_schema and len(own) > 1:
        return _same([read_csv(spark, p, o) for p in own])
    lines = _lines(spark, own, o)
    typed = _typed(lines, o)
    names = list(o.include_columns)
    if not names:
        return typed
    missing = [c for c in names if c not in typed.columns]
    if missing and not o.include_missing_columns:
        raise KeyError(f"no columns {missing}")
    return typed.select(*[F.lit(None).cast("string").alias(c) if c in missing else col(c) for c in names])


def read_csv_many(spark: SparkSession, paths: Sequence[str], options: CSVReadOptions | None = None) -> list[DataFrame]:
    """A frame for each file."""
    return [read_csv(spark, p, options) for p in paths]


def _reader(spark: SparkSession, o: CSVReadOptions):
    r = spark.read.option("sep", o.delimiter).option("quote", o.quote if o.use_quoting else "").option("multiLine", o.newlines_in_values).option("enforceSchema", False)
    escape = o.escape if o.use_escaping else (o.quote if o.double_quote else "\\")
    return r.option("escape", escape).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)


def _lines(spark: SparkSession, paths: list[str], o: CSVReadOptions) -> DataFrame:
    """All values as strings, empty ones as empty text."""
    keep_empty = lambda r: r.option("nullValue", "\0").option("emptyValue", "")
    if not o.skip_rows:
        df = keep_empty(_reader(spark, o)).option("header", o.header).option("inferSchema", False).csv(paths)
        names = list(o.column_names) or (df.columns if o.header else [str(i) for i in range(len(df.columns))])
        if len(names) != len(df.columns):
            raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
        return df.toDF(*names)
    return _records(spark, paths, o) if o.newlines_in_values else _after_skipped(spark, paths, o)


def _named(records: list[list[str]], o: CSVReadOptions) -> list[str]:
    """Names of the columns, from the options or the first record left."""
    names = list(o.column_names) or ((records[0] if o.header else [str(i) for i in range(len(records[0]))]) if records else [])
    if not names:
        raise ValueError("no rows are left to read")
    return names


def _dialect(o: CSVReadOptions) -> dict:
    return {"delimiter": o.delimiter, "quotechar": o.quote if o.use_quoting else None, "quoting": csv.QUOTE_MINIMAL if o.use_quoting else csv.QUOTE_NONE, "doublequote": o.double_quote, "escapechar": o.escape if o.use_escaping else None}


def _after_skipped(spark: SparkSession, paths: list[str], o: CSVReadOptions) -> DataFrame:
    """All values as strings, without the first lines of each file, of which only the first block is numbered."""
    text = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    start = text.filter("b = 0").withColumn("n", F.row_number().over(Window.partitionBy("f").orderBy("m"))).filter(F.col("n") > o.skip_rows)
    first = start.filter(F.col("n") == o.skip_rows + 1).orderBy("f").select("value").first()
    named = _named(list(csv.reader([first[0]], **_dialect(o))) if first else [], o)
    if o.header:
        start = start.filter(F.col("n") > o.skip_rows + 1)
    rest = start.select("value").unionAll(text.filter("b > 0").select("value"))
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in named)
    opts = {"sep": o.delimiter, "quote": o.quote if o.use_quoting else "", "escape": o.escape if o.use_escaping else (o.quote if o.double_quote else "\\"), "nullValue": "\0"}
    rows = rest.filter(F.length("value") > 0) if o.ignore_empty_lines else rest
    return rows.select(F.from_csv("value", schema, opts).alias("r")).select("r.*").na.fill("")


def _records(spark: SparkSession, paths: list[str], o: CSVReadOptions) -> DataFrame:
    """As ``_after_skipped`` for values that may hold line breaks: a file can then only be read from its start, in one task.

    Missing values at the end of a record are empty, values beyond the last column are left out.
    """
    dialect, skip, header, empty = _dialect(o), o.skip_rows, o.header, not o.ignore_empty_lines

    def split(content: bytes):
        lines = io.StringIO(content.decode("utf-8-sig"), newline="")
        for _ in range(skip):
            lines.readline()
        return (r for r in csv.reader(lines, **dialect) if r or empty)

    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def first(batches):
        for pdf in batches:
            found = [(p, next(split(c), None)) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame([x for x in found if x[1] is not None], columns=["path", "cells"])

    top = files.mapInPandas(first, "path string, cells array<string>").orderBy("path").first()
    named = _named([list(top["cells"])] if top else [], o)
    n = len(named)

    def rows(batches):
        for pdf in batches:
            for content in pdf["content"]:
                own = split(content)
                if header:
                    next(own, None)
                while part := list(itertools.islice(own, 10_000)):
                    yield pd.DataFrame([(r + [""] * n)[:n] for r in part], columns=[f"c{i}" for i in range(n)], dtype=object)

    return files.mapInPandas(rows, ", ".join(f"c{i} string" for i in range(n))).toDF(*named)


def _typed(df: DataFrame, o: CSVReadOptions) -> DataFrame:
    nulls, yes, no = list(o.null_values), list(o.true_values), list(o.false_values)
    empty = {c: col(c).isin(nulls) for c in df.columns}
    as_bool = lambda c: F.when(col(c).isin(yes), True).when(col(c).isin(no), False)
    tries = {
        "bigint": lambda c: F.when(col(c).rlike(r"^[+-]?\d{1,19}$"), col(c).try_cast("bigint")),
        "double": lambda c: F.when(col(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?inf$"), col(c).try_cast("double")),
        "boolean": as_bool,
        "timestamp_ntz": lambda c: F.when(col(c).rlike(r"^\d{4}-\d\d-\d\d([ T]\d\d:\d\d(:\d\d(\.\d+)?)?)?$"), col(c).try_cast("timestamp_ntz")),
    }
    free = [c for c in df.columns if c not in o.column_types]
    found: dict[str, str] = {}
    if free:
        counts = [F.count(F.when(~empty[c], 1)).alias(f"n{i}") for i, c in enumerate(free)]
        counts += [F.count(F.when(~empty[c], fn(c))).alias(f"{k}{i}") for i, c in enumerate(free) for k, fn in tries.items()]
        row = df.agg(*counts).first()
        found = {c: next((k for k in tries if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]), "string") for i, c in enumerate(free)}

    def one(c: str) -> Column:
        if c in found:
            if found[c] == "string":
                return (F.when(~empty[c], col(c)) if o.strings_can_be_null else col(c)).alias(c)
            return F.when(~empty[c], tries[found[c]](c)).alias(c)
        kind = resolve_type(o.column_types[c])
        if kind.simpleString() == "string":
            return (F.when(~empty[c], col(c)) if o.strings_can_be_null else col(c)).alias(c)
        return F.when(~empty[c], as_bool(c) if kind.simpleString() == "boolean" else col(c).cast(kind)).alias(c)

    return df.select(*[one(c) for c in df.columns])


def read_parquet(spark: SparkSession, paths: Paths, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of all files; only the named columns are read. A path of a ``_metadata`` file stands for its folder."""
    df = spark.read.parquet(*[p.removesuffix("/_metadata") for p in listed(paths)])
    return df if columns is None else df.select(*[col(c) for c in columns])


def read_parquet_many(spark: SparkSession, paths: Sequence[str]) -> list[DataFrame]:
    """A frame for each file."""
    return [read_parquet(spark, p) for p in paths]


def read_json(spark: SparkSession, paths: Paths, lines: bool = True) -> DataFrame:
    """Rows of JSON lines, or of arrays of objects."""
    return spark.read.option("multiLine", not lines).json(listed(paths))
