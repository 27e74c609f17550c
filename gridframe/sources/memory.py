"""Frames from what is in the driver's memory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gridframe.functions.types import from_arrow_schema, storable_arrow


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    """An Arrow table; types that Spark lacks are widened first."""
    kinds = pa.schema([(f.name, storable_arrow(f.type)) for f in table.schema])
    if not table.num_columns:
        return empty(spark)
    cast = pa.table([c.cast(f.type, safe=False) for c, f in zip(table.columns, kinds, strict=True)], schema=kinds)
    if not cast.num_rows:
        return spark.createDataFrame([], from_arrow_schema(kinds))
    return spark.createDataFrame(cast)


def from_columns(spark: SparkSession, columns: Sequence, names: Sequence[str]) -> DataFrame:
    """Columns of one length with their names; ValueError for different lengths."""
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c.tolist() if isinstance(c, np.ndarray) and c.dtype == object else c) for c in columns]
    if len(arrays) != len(names) or len({len(a) for a in arrays}) > 1:
        raise ValueError(f"{len(names)} names for columns of lengths {[len(a) for a in arrays]}")
    return from_arrow(spark, pa.table(arrays, names=[str(n) for n in names]))


def from_list(spark: SparkSession, columns: Sequence[Sequence], names: Sequence[str] | None = None) -> DataFrame:
    """A list of columns (not rows); names are 0, 1, 2 ... unless given. A flat list is one column."""
    if columns and not isinstance(columns[0], (list, tuple, np.ndarray)):
        columns = [columns]
    return from_columns(spark, columns, names or [str(i) for i in range(len(columns))])


def from_numpy(spark: SparkSession, columns: Sequence[np.ndarray], names: Sequence[str] | None = None) -> DataFrame:
    """A list of one-dimensional arrays as columns."""
    return from_list(spark, list(columns), names)


def from_pydict(spark: SparkSession, columns: Mapping[str, Sequence]) -> DataFrame:
    """Columns by name."""
    return from_columns(spark, list(columns.values()), list(columns))


def from_pandas(spark: SparkSession, frame: pd.DataFrame) -> DataFrame:
    """A pandas frame without its index."""
    return from_arrow(spark, pa.Table.from_pandas(frame, preserve_index=False))


def empty(spark: SparkSession, schema: T.StructType | str | None = None) -> DataFrame:
    """No rows; no columns either, unless a schema is given."""
    return spark.createDataFrame([], schema or T.StructType([]))
