"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or our own folder where that is unset and all tasks run on this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_scratch: ContextVar[list | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that materialise() has made in it; for work whose results are stored elsewhere by then."""
    paths: list[str] = []
    token = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in paths:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(hadoop, True)
            fs.cancelDeleteOnExit(hadoop)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, with its scheme, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/tesselix/{what}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.getParent())
    fs.deleteOnExit(hadoop)
    return fs.makeQualified(hadoop).toString()


def materialise(df: DataFrame, what: str = "table") -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: lineage ends here, and what lost executors had
    made is still there."""
    path = fresh_path(df.sparkSession, what)
    if (held := _scratch.get()) is not None:
        held.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
