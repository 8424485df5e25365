"""Report sinks: single reports, and sets of reports that appear as a whole."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from labelscope.sources.scratch import exists
from labelscope.sources.tables import NULL_MARK, read_csv, write_csv


def write_report(df: DataFrame, path: str, fmt: str = "csv", single_file: bool = False) -> str:
    """Write one report, replacing an older one at the same path.

    Pass ``single_file=True`` for a report of at most one row per pair of
    features; it must not be set for anything that grows with the rows.
    """
    if single_file:
        # a shuffle of the few finished rows: the plan before it stays parallel
        df = df.repartition(1)
    if fmt == "csv":
        return write_csv(df, path, "overwrite")
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def read_report(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, schema, NULL_MARK)
    return spark.read.format(fmt).schema(schema).load(path)


_NOTE = "run string, finished string"


def publish(spark: SparkSession, path: str, write: Callable[[str], object]) -> str:
    """Let ``write`` put a set of reports into a new folder, and make it the last run.

    The note that names the run is written after everything else, so readers
    see either all reports of a run or those of the run before; what a failed
    run leaves behind is never read. Returns the folder of the run.
    """
    started = datetime.now(UTC).strftime("%Y%m%dT%H%M%S")
    run = f"runs/{started}-{uuid4().hex[:12]}"
    write(f"{path}/{run}")
    finished = datetime.now(UTC).isoformat(timespec="microseconds")
    note = spark.createDataFrame([(run, finished)], _NOTE)
    note.coalesce(1).write.mode("append").parquet(f"{path}/finished")
    return f"{path}/{run}"


def published_runs(spark: SparkSession, path: str) -> list[str]:
    """The folders of the complete runs, the last one last."""
    if not exists(spark, f"{path}/finished"):
        return []
    notes = spark.read.schema(_NOTE).parquet(f"{path}/finished").collect()
    return [f"{path}/{n.run}" for n in sorted(notes, key=lambda n: (n.finished, n.run))]


def published_report(
    spark: SparkSession, path: str, name: str, schema: T.StructType | None = None, fmt: str = "csv"
) -> DataFrame:
    """A report of the last complete run."""
    runs = published_runs(spark, path)
    if not runs:
        raise ValueError(f"no complete run in {path}")
    if fmt == "csv":
        return read_csv(spark, f"{runs[-1]}/{name}", schema, NULL_MARK)
    reader = spark.read.format(fmt)
    return (reader if schema is None else reader.schema(schema)).load(f"{runs[-1]}/{name}")
