"""Mergeable states: what the reports need of a table, per month and feature.

A state holds sums, counts, moments, extremes and a sketch of the distinct values.
Two states merge into that of both tables, so a report over all months needs the
rows of the new ones only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.columns import parse_date, quoted, ratio
from labelscope.operators.describe import summarised
from labelscope.operators.longform import feature_name, numeric_long, text_long
from labelscope.roles import Roles

# Buckets of a sketch of distinct values: 2 to this power, for an error of 1.6 %.
SKETCH_BITS = 12


def _month(df: DataFrame, roles: Roles):
    month = F.trunc(parse_date(df, roles.date), "MM") if roles.date else F.lit(None)
    return month.cast("date").alias("month_start")


def month_states(df: DataFrame, roles: Roles) -> DataFrame:
    """``month_start, total_apps, total_booked, total_fraud`` of one table."""
    booked = F.col(quoted(roles.booked)) if roles.booked else F.lit(None).cast("bigint")
    return (
        df.select(_month(df, roles), booked.alias("b"), roles.target().alias("y"))
        .groupBy("month_start")
        .agg(
            F.count("*").alias("total_apps"),
            F.sum("b").alias("total_booked"),
            F.sum("y").alias("total_fraud"),
        )
    )


def feature_states(df: DataFrame, roles: Roles) -> DataFrame:
    """One row per month and feature of one table.

    The label and the booked flag have a row as numbers too, for the numeric
    summary, and ``reported`` is false for them. Nothing but one row per task,
    month and feature is shuffled.
    """
    numeric, other = summarised(df, roles)
    features = set(roles.features(df))
    month, y = _month(df, roles), roles.target().alias("y")
    missing = F.col("value").isNull()
    shared = [
        F.count("*").alias("rows"),
        F.count_if(missing).alias("null_count"),
        F.sum(F.when(missing, F.col("y"))).alias("bad_missing"),
        F.sum(F.when(~missing, F.col("y"))).alias("bad_present"),
        F.count("value").alias("n"),
    ]
    values = F.hll_sketch_agg(F.col("value").cast("string"), F.lit(SKETCH_BITS)).alias("values")
    moments = [
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("m2"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    ]
    parts = [
        long.groupBy("month_start", "fid")
        .agg(*shared, *more, values)
        .withColumn("feature", feature_name(names))
        .withColumn("numeric", F.lit(is_number))
        .drop("fid")
        for long, names, more, is_number in (
            (numeric_long(df, numeric, month, y), numeric, moments, True),
            (text_long(df, other, month, y), other, [], False),
        )
    ]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True)
    reported = F.col("feature").isin(*features) if features else F.lit(False)
    return both.withColumn("reported", reported)


def merged_months(states: DataFrame) -> DataFrame:
    """The states of all tables together, one row per month."""
    names = ("total_apps", "total_booked", "total_fraud")
    return states.groupBy("month_start").agg(*[F.sum(c).alias(c) for c in names])


def merged_features(states: DataFrame, by_month: bool = False) -> DataFrame:
    """The states of all tables together, one row per feature (and month).

    Moments are merged about the common mean, so they lose no digits where the
    mean is large.
    """
    key = ["feature", "numeric", "reported", *(["month_start"] if by_month else [])]
    every = Window.partitionBy(*key)
    mean = F.sum(F.col("mean") * F.col("n")).over(every) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n"))).over(every)
    shift = F.col("mean") - F.col("common")
    return (
        states.withColumn("common", F.when(F.sum("n").over(every) > 0, mean))
        .withColumn("spread", F.col("m2") + F.col("n") * shift * shift)
        .groupBy(*key)
        .agg(
            *[F.sum(c).alias(c) for c in ("rows", "null_count", "bad_missing", "bad_present", "n")],
            F.max("common").alias("mean"),
            F.sum("spread").alias("m2"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.hll_union_agg("values", F.lit(True)).alias("values"),
        )
    )


def monthly_from_states(months: DataFrame) -> DataFrame:
    """The monthly report, from the states of any number of tables."""
    apps = F.col("total_apps")
    return (
        merged_months(months)
        .withColumn("booked_rate", ratio(F.col("total_booked"), apps))
        .withColumn("fraud_rate", ratio(F.col("total_fraud"), apps))
        .orderBy("month_start")
    )


def missing_from_states(features: DataFrame) -> DataFrame:
    """The report of missing values, from the states of any number of tables."""
    nulls, rows = F.col("null_count"), F.col("rows")
    return (
        merged_features(features.where("reported"))
        .select(
            "feature",
            ratio(nulls, rows).alias("missing_rate"),
            ratio(F.col("bad_missing"), nulls).alias("fraud_rate_missing"),
            ratio(F.col("bad_present"), rows - nulls).alias("fraud_rate_present"),
            "null_count",
        )
        .orderBy(F.desc("missing_rate"), "feature")
    )


def numeric_from_states(features: DataFrame) -> DataFrame:
    """Count, mean, sample std, min and max of the numeric features."""
    std = F.sqrt(F.try_divide(F.col("m2"), (F.col("n") - 1).cast("double")))
    return merged_features(features.where("numeric")).select(
        "feature",
        F.col("n").alias("count"),
        "mean",
        F.when(F.col("n") > 1, std).alias("std"),
        F.col("low").alias("min"),
        F.col("high").alias("max"),
    )


def distinct_from_states(features: DataFrame) -> DataFrame:
    """Present and null count and the estimated number of distinct values of each feature."""
    return merged_features(features.where("reported")).select(
        "feature",
        F.col("n").alias("count"),
        "null_count",
        F.hll_sketch_estimate("values").alias("distinct_estimate"),
    )
