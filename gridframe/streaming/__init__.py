"""Structured Streaming entry points: an extension, for tables that arrive in pieces."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gridframe.operators.aggregates import expression


def files(spark: SparkSession, path: str, schema: T.StructType, per_batch: int = 1, kind: str = "parquet") -> DataFrame:
    """Files that appear in a folder, some in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(kind).load(path)


def windowed(events: DataFrame, time: str, window: str, keys: list[str], spec: Mapping[str, str], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates by time window and keys; events later than ``late`` behind the newest are left out, and state is dropped.

    Columns: ``window_start``, ``window_end``, the keys, then ``op_column``.
    """
    if isinstance(events.schema[time].dataType, T.TimestampNTZType):  # watermarks need instants: take the session's zone
        events = events.withColumn(time, F.col(time).cast("timestamp"))
    own = events.withWatermark(time, late).groupBy(F.window(time, window, slide or window).alias("w"), *keys)
    out = own.agg(*[expression(events, c, op).alias(f"{op}_{c}") for c, op in spec.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[f"{op}_{c}" for c, op in spec.items()])


def each_piece(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """``fn(frame, number)`` of every micro-batch until the input is used up: the pieces of a table inserted one by one."""
    return stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Results into an in-memory table of that name, until the input is used up."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
