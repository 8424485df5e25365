"""The application table as it grows by files, and its states after two runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.operators.describe import categorical_describe
from labelscope.operators.states import distinct_from_states
from labelscope.plans.incremental import read_states, update_states
from labelscope.sources import shared_folder
from verification.inputs import APPLICATION_ROLES, application_table

_stored: dict[tuple[str, str], str] = {}


def two_runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Feature and month states after the even rows, and then the odd ones, have come in."""
    app = spark.sparkContext.applicationId
    if (app, folder) not in _stored:
        rows = application_table(spark, folder)
        base = f"{shared_folder(spark)}/labelscope/{app}/growing-{uuid.uuid4().hex[:12]}"
        for half in (0, 1):
            new = rows.where(F.col("application_id") % 2 == half)
            new.write.mode("append").parquet(f"{base}/rows")
            update_states(spark, f"{base}/rows", APPLICATION_ROLES, f"{base}/states")
        _stored[app, folder] = f"{base}/states"
    return read_states(spark, _stored[app, folder])


def distinct_within(spark: SparkSession, folder: str, most: float = 0.05) -> DataFrame:
    """``(feature, within)``: whether each merged sketch is within its error of the exact count."""
    table = application_table(spark, folder)
    exact = categorical_describe(table, APPLICATION_ROLES, APPLICATION_ROLES.features(table))
    found = distinct_from_states(two_runs(spark, folder)[0]).select("feature", "distinct_estimate")
    off = F.abs(F.col("distinct_estimate") - F.col("distinct_count"))
    return exact.join(found, "feature").select(
        "feature", (off <= most * F.col("distinct_count") + 1).alias("within")
    )
