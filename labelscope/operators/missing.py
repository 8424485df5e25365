"""Missing rates and what missingness says about the label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.functions.columns import ratio
from labelscope.operators.longform import feature_name, missing_long
from labelscope.roles import Roles


def missing_stats(df: DataFrame, roles: Roles) -> DataFrame:
    """Per feature: missing rate, label rate where missing and where present.

    A rate over no rows is null. Ordered by missing rate, highest first.
    """
    features = roles.features(df)
    long = missing_long(df, features, roles.numeric(df), roles.target().alias("y"))
    nulls, rows = F.col("null_count"), F.col("rows")
    return (
        long.groupBy("fid")
        .agg(
            F.count("*").alias("rows"),
            F.count_if("missing").alias("null_count"),
            F.sum(F.when(F.col("missing"), F.col("y"))).alias("bad_missing"),
            F.sum(F.when(~F.col("missing"), F.col("y"))).alias("bad_present"),
        )
        .select(
            feature_name(features).alias("feature"),
            ratio(nulls, rows).alias("missing_rate"),
            ratio(F.col("bad_missing"), nulls).alias("fraud_rate_missing"),
            ratio(F.col("bad_present"), rows - nulls).alias("fraud_rate_present"),
            "null_count",
        )
        .orderBy(F.desc("missing_rate"), "feature")
    )


def significant_missing(stats: DataFrame, threshold: float = 0.001) -> DataFrame:
    """Rows of :func:`missing_stats` with a missing rate above the threshold."""
    return stats.where(F.col("missing_rate") > threshold)
