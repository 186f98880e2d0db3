"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None

#: Work tables that the innermost open `passing` has seen.
_made: ContextVar[list[tuple[DataFrame, str]] | None] = ContextVar("made", default=None)

#: Whether Spark (4.1 or later) removes the shuffle files of an execution at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this process only where that is unset and all runs in it, as in tests."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="stratagraph-")
    return _own


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stratagraph/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts the lineage and survives lost executors.

    Shuffle files of the write go when it ends; else they stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = work_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    if (made := _made.get()) is not None:
        made.append((out, path))
    return out


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Work tables cut within are removed at its end, but for those handed to what it gives; nothing read later may need them."""
    outer, own, kept = _made.get(), [], []
    token = _made.set(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _made.reset(token)
        for df, path in own:
            if not any(df is k for k in kept):
                spark = df.sparkSession
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            elif outer is not None:
                outer.append((df, path))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
