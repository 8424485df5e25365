"""Intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_temporary: ContextVar[list[str] | None] = ContextVar("temporary", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder from ``spark.checkpoint.dir``.

    When none is configured a temporary folder is used, but only in local mode
    where driver and executors share one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="labelscope-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def materialize(df: DataFrame, name: str, temporary: bool = True) -> DataFrame:
    """Write a table to the shared folder once and read it back.

    Later passes scan only the columns they use, and a lost executor costs a
    re-read rather than a re-run of everything upstream. A table that isn't
    ``temporary`` outlives :func:`temporary_tables`.
    """
    spark = df.sparkSession
    run = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/labelscope/{run}/{name}-{uuid.uuid4().hex[:12]}"
    paths = _temporary.get()
    if paths is not None and temporary:
        paths.append(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that :func:`materialize` stores inside when it ends.

    For work that is finished by then, such as writing reports. Results that
    are still to be computed need the tables they read.
    """
    token = _temporary.set([])
    try:
        yield
    finally:
        paths = _temporary.get() or []
        _temporary.reset(token)
        remove(spark, paths)


def _placed(spark: SparkSession, name: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    """Whether there is a file or folder of that name."""
    path, system = _placed(spark, name)
    return system.exists(path)


def touch(spark: SparkSession, name: str) -> None:
    """An empty file."""
    path, system = _placed(spark, name)
    system.create(path, True).close()


def remove(spark: SparkSession, names: Iterable[str]) -> None:
    """Remove files, or stored tables that nothing reads any more."""
    for name in names:
        path, system = _placed(spark, name)
        system.delete(path, True)
