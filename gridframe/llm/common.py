"""What the operators share: scratch tables, word rules, folds and Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.session import scratch_dir, stored  # noqa: F401  for the operators

#: A word is a run of characters other than these (space, tab, line feed, vertical tab, form feed, return).
SPACES = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
GAP_RE = r"[\x20\x09-\x0D]+"


#: Bytes of an Arrow batch that goes to a Python worker; texts are long, so Spark's own 64 MB is much for small executors.
BATCH = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this package where only the driver had it on its path, and keep their batches small.

    The session's batch size is set only where it is still Spark's default.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, "64m") in ("67108864b", "64m"):
        spark.conf.set(size, BATCH)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, n: int) -> Column:
    """``crc32`` of the id as text, modulo ``n``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def utf8(c: str = "text") -> Column:
    """The text as UTF-8 bytes, which Arrow hands to Python without decoding."""
    return F.col(c).cast("binary")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with one output batch for each input batch."""
    return map_parts(df, lambda b: iter((fn(b),)), schema)


def map_parts(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the output batches that ``fn`` gives one after the other for each input batch."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give memory that a task no longer uses back to the system: workers stay for a while, beside tasks that need none."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc keeps freed memory and has a call for it
        ctypes.CDLL(None).malloc_trim(0)
