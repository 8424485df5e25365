"""Summaries of numeric and categorical features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.operators.longform import feature_name, numeric_long, text_long
from labelscope.operators.quantiles import Known, approx_quantiles, feature_quantiles
from labelscope.roles import Roles

# The reported percentiles.
PERCENTILES = {
    "p1": 0.01,
    "p10": 0.10,
    "p25": 0.25,
    "p50": 0.50,
    "p75": 0.75,
    "p90": 0.90,
    "p99": 0.99,
}


def summarised(df: DataFrame, roles: Roles) -> tuple[list[str], list[str]]:
    """The features of the summary: label and booked flag too, but not the date."""
    keep = tuple(c for c in (roles.label, roles.booked) if c and c not in roles.ignore)
    return roles.numeric(df, keep), roles.categorical(df, keep)


def numeric_describe(
    df: DataFrame, roles: Roles, features: Sequence[str] | None = None
) -> DataFrame:
    """Per numeric feature: count, mean, sample std, min, max of present values."""
    features = list(features or summarised(df, roles)[0])
    return (
        numeric_long(df, features)
        .groupBy("fid")
        .agg(
            F.count("value").alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
        .select(feature_name(features).alias("feature"), "count", "mean", "std", "min", "max")
    )


def numeric_percentiles(
    df: DataFrame,
    roles: Roles,
    features: Sequence[str] | None = None,
    method: str = "exact",
    accuracy: int = 10_000,
    known: Known | None = None,
) -> DataFrame:
    """p1 … p99 per numeric feature, exact and interpolated or sketched."""
    features = list(features or summarised(df, roles)[0])
    names, probs = list(PERCENTILES), list(PERCENTILES.values())
    if method == "exact":
        q = feature_quantiles(df, features, probs, names, known)
    elif method == "approx":
        q = approx_quantiles(numeric_long(df, features), probs, names, accuracy)
    else:
        raise ValueError(f"unknown method {method!r}")
    return q.select(feature_name(features).alias("feature"), *names)


def numeric_summary(
    df: DataFrame,
    roles: Roles,
    method: str = "exact",
    accuracy: int = 10_000,
    known: Known | None = None,
) -> DataFrame:
    """:func:`numeric_describe` with the percentiles beside it; null where a
    feature has no value at all."""
    features = summarised(df, roles)[0]
    basic = numeric_describe(df, roles, features)
    percentiles = numeric_percentiles(df, roles, features, method, accuracy, known)
    return basic.join(percentiles, "feature", "left")


def categorical_describe(
    df: DataFrame, roles: Roles, features: Sequence[str] | None = None
) -> DataFrame:
    """Per other feature: present count, null count, exact distinct count.

    Values are counted first and features second, so a frequent value costs one
    row per task and a high-cardinality feature is spread over all tasks.
    """
    features = list(features or summarised(df, roles)[1])
    per_value = text_long(df, features).groupBy("fid", "value").agg(F.count("*").alias("n"))
    present = F.col("value").isNotNull()
    return (
        per_value.groupBy("fid")
        .agg(
            F.sum(F.when(present, F.col("n")).otherwise(0)).alias("count"),
            F.sum(F.when(present, 0).otherwise(F.col("n"))).alias("null_count"),
            F.count_if(present).alias("distinct_count"),
        )
        .select(feature_name(features).alias("feature"), "count", "null_count", "distinct_count")
    )
