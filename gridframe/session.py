"""The session façade and the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates, ``spark.checkpoint.dir``.

    Only a session of one process may leave it unset, and then a folder of this machine is set; elsewhere executors would
    not see each other's files, which is a RuntimeError.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "gridframe-checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; its rows stay as they are if an executor is lost.

    The copy stays until ``discard``, since lazy frames may still need it.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables this process has stored and not discarded; a mark for ``discard``."""
    return len(_written)


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete what this process has stored in the shared folder since the mark ``since``, but for the last ``keep`` tables; frames made of it can no longer be read."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    end = max(since, len(_written) - keep)
    for name in _written[since:end]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del _written[since:end]


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with this library's defaults; on a cluster, make the session as usual."""
    built = SparkSession.builder.master(f"local[{cores}]").appName("gridframe")
    base = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    for k, v in (base | conf).items():
        built = built.config(k, v)
    return built.getOrCreate()


class Env:
    """What programs written for processes and ranks expect; Spark has one driver, so the rank is 0.

    Every operator takes an ``env`` and ignores it: local and distributed forms are one plan here.
    """

    def __init__(self, config=None, distributed: bool = True, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.getActiveSession() or local_session()
        self.is_distributed = distributed
        self.config: dict[str, str] = dict(config) if isinstance(config, dict) else {}  # communicator settings mean nothing here

    @property
    def rank(self) -> int:
        return 0

    @property
    def world_size(self) -> int:
        """The parallelism that Spark would use by default."""
        return self.spark.sparkContext.defaultParallelism

    def barrier(self) -> None:
        """Nothing: an action returns when all its tasks have."""

    def finalize(self) -> None:
        """Nothing: the session belongs to whoever made it."""

    def add_config(self, key: str, value: str) -> None:
        self.config[key] = value

    def get_config(self, key: str, default: str | None = None) -> str | None:
        return self.config.get(key, default)
