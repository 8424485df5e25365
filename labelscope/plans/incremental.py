"""States of a growing table, kept up to date by reading its new files only."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from labelscope.operators.states import feature_states, month_states
from labelscope.roles import Roles
from labelscope.sources.scratch import exists, temporary_tables

# States that a task keeps in memory at a time, some 5 KB each. With more of them
# (by default with more than 128) Spark sorts all rows by month and feature instead.
STATES_IN_MEMORY = 10_000
_IN_MEMORY = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"

_NOTE = "batch string, files array<string>, schema string, roles string"


def update_states(spark: SparkSession, table: str, roles: Roles, path: str) -> str | None:
    """Bring the states below ``path`` up to the files of the Parquet table.

    Files that an earlier run has read are not opened again; partition columns
    are kept. The states of the new files are written first, and the note that
    lists these files last, so a run that fails changes nothing. Returns the
    name of the new batch, or None if there are no new files.

    A table is meant to grow by files. If one that was read is gone, or the roles
    are others, the states no longer describe the table, and the run fails.
    """
    notes = _notes(spark, path)
    reader = spark.read
    if notes:
        reader = reader.schema(T.StructType.fromJson(json.loads(notes[0].schema)))
        if any(n.roles != repr(roles) for n in notes):
            raise ValueError(f"the states in {path} are of other roles")
    listed = reader.parquet(table)
    files = set(listed.inputFiles())
    read = {f for n in notes for f in n.files}
    if read - files:
        raise ValueError(f"files of {table} that were read are gone: {sorted(read - files)[:3]}")
    new = sorted(files - read)
    if not new:
        return None
    batch = uuid4().hex
    rows = spark.read.schema(listed.schema).option("basePath", table).parquet(*new)
    with temporary_tables(spark), _states_in_memory(spark):
        # merged by many tasks, and written by one
        feature_states(rows, roles).repartition(1).write.parquet(f"{path}/features/{batch}")
        month_states(rows, roles).repartition(1).write.parquet(f"{path}/months/{batch}")
    note = [(batch, new, json.dumps(listed.schema.jsonValue()), repr(roles))]
    spark.createDataFrame(note, _NOTE).coalesce(1).write.mode("append").parquet(f"{path}/batches")
    return batch


@contextmanager
def _states_in_memory(spark: SparkSession) -> Iterator[None]:
    """The session's setting is put back at the end; a greater one is left as it is."""
    before = spark.conf.get(_IN_MEMORY)
    spark.conf.set(_IN_MEMORY, max(int(before), STATES_IN_MEMORY))
    try:
        yield
    finally:
        spark.conf.set(_IN_MEMORY, before)


def _notes(spark: SparkSession, path: str) -> list:
    if not exists(spark, f"{path}/batches"):
        return []
    return spark.read.schema(_NOTE).parquet(f"{path}/batches").collect()


def read_states(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The feature states and the month states of all complete batches."""
    batches = sorted(n.batch for n in _notes(spark, path))
    if not batches:
        raise ValueError(f"no states in {path}")
    return tuple(
        spark.read.parquet(*[f"{path}/{kind}/{b}" for b in batches]) for kind in ("features", "months")
    )


