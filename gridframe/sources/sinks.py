"""Writing frames, and bringing them to the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from gridframe.sources.options import CSVWriteOptions, ParquetOptions


NameFunction = Callable[[int], str] | None


def _named(df: DataFrame, path: str, name: NameFunction) -> None:
    """Part files in the order of their partitions renamed to ``name(0)``, ``name(1)`` ..."""
    if name is None:
        return
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(x.getPath().getName() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-"))
    if len({name(i) for i in range(len(parts))}) < len(parts):
        raise ValueError("the function gives two files one name")
    for i, part in enumerate(parts):
        fs.rename(spark._jvm.org.apache.hadoop.fs.Path(folder, part), spark._jvm.org.apache.hadoop.fs.Path(folder, name(i)))


def write_csv(df: DataFrame, path: str, options: CSVWriteOptions | None = None, mode: str = "overwrite", name_function: NameFunction = None) -> None:
    """A folder of CSV files with headers, one a partition, named by Spark or by a function of the partition's number."""
    o = options or CSVWriteOptions()
    if o.column_names:
        if len(o.column_names) != len(df.columns):
            raise ValueError(f"{len(o.column_names)} names for {len(df.columns)} columns")
        df = df.toDF(*o.column_names)
    df.write.mode(mode).option("header", True).option("sep", o.delimiter).csv(path)
    _named(df, path, name_function)


def write_parquet(df: DataFrame, path: str, options: ParquetOptions | None = None, mode: str = "overwrite", name_function: NameFunction = None) -> None:
    """A folder of Parquet files, one a partition or more; with ``metadata_file`` also ``_metadata``, the footers of all files in one."""
    o = options or ParquetOptions()
    if o.metadata_file and (o.chunk_size or name_function):
        raise ValueError("a metadata file names the files as they are written: no chunk_size or name_function with it")
    w = df.write.mode(mode).options(**({"parquet.summary.metadata.level": "ALL"} if o.metadata_file else {}), **o.writer)
    (w.option("maxRecordsPerFile", o.chunk_size) if o.chunk_size else w).parquet(path)
    _named(df, path, name_function)


def write_json(df: DataFrame, path: str, mode: str = "overwrite", name_function: NameFunction = None) -> None:
    """A folder of files of JSON lines, nulls included."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    _named(df, path, name_function)


def to_arrow(df: DataFrame) -> pa.Table:
    """All rows in the driver's memory."""
    return df.toArrow()


def to_pandas(df: DataFrame) -> pd.DataFrame:
    return df.toPandas()


def to_numpy(df: DataFrame, order: str = "F") -> np.ndarray:
    """A two-dimensional array, a column for each column."""
    return np.array(df.toPandas().to_numpy(), order=order)


def to_dict(df: DataFrame) -> dict[str, list]:
    """Columns as lists by name."""
    return df.toArrow().to_pydict()
