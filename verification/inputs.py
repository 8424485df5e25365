"""Labelled tables over the given data, as inputs of the registered queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.plans.applications import ROLES as APPLICATION_ROLES
from labelscope.plans.applications import applications
from labelscope.roles import Roles
from labelscope.sources import materialize, read_table

DOCUMENT_ROLES = Roles(label="quality", ignore=("doc_id",))
EVENT_ROLES = Roles(label="bought", date="ts", booked="booked", ignore=("event_id", "user_id"))
LINE_ROLES = Roles(label="returned", date="l_shipdate")
VECTOR_ROLES = Roles(label="upper_half", ignore=("vec_id",))

# Bytes of a file that a task reads while the application table is derived. A task
# holds a state for every order in its part of the line items, some 15 times its size.
SPLIT_BYTES = 32 << 20
_SPLIT = "spark.sql.files.maxPartitionBytes"

_stored: dict[tuple[str, str], DataFrame] = {}


def application_table(spark: SparkSession, folder: str) -> DataFrame:
    """The application table, derived and stored once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _stored:
        before = spark.conf.get(_SPLIT)
        spark.conf.set(_SPLIT, _smaller(before))
        try:
            _stored[key] = materialize(applications(spark, folder), "applications")
        finally:
            spark.conf.set(_SPLIT, before)
    return _stored[key]


def _smaller(size: str) -> str:
    """A size in Spark's notation, or ``SPLIT_BYTES`` if that is less."""
    found = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", size.strip().lower())
    units = {"": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}
    own = int(found[1]) << units[found[2]] if found else 0
    return size if 0 < own <= SPLIT_BYTES else str(SPLIT_BYTES)


def document_table(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, f"{folder}/documents.parquet")
    labels = read_table(spark, f"{folder}/labels.parquet")
    return documents.join(labels, "doc_id", "left")


def event_table(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, f"{folder}/events.parquet")
    kind = F.col("event_type")
    return events.select(
        "event_id",
        "ts",
        "user_id",
        (kind == "purchase").cast("int").alias("bought"),
        (kind == "signup").cast("int").alias("booked"),
        "value",
        "props",
    )


def line_table(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, f"{folder}/lineitem.parquet")
    return lines.select(
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        "l_shipdate",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        "l_linestatus",
    )


def vector_table(spark: SparkSession, folder: str) -> DataFrame:
    """One numeric column per vector dimension, as many as the longest vector has."""
    vectors = read_table(spark, f"{folder}/embeddings.parquet")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    dims = [F.get("embedding", F.lit(i)).alias(f"d{i}") for i in range(width)]
    return vectors.select("vec_id", (F.col("label") >= 5).cast("int").alias("upper_half"), *dims)


__all__ = [
    "APPLICATION_ROLES",
    "DOCUMENT_ROLES",
    "EVENT_ROLES",
    "LINE_ROLES",
    "VECTOR_ROLES",
    "application_table",
    "document_table",
    "event_table",
    "line_table",
    "vector_table",
]
