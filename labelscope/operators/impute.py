"""Median imputation and outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.functions.columns import double_sql, quoted
from labelscope.operators.longform import feature_name, numeric_long, with_per_feature
from labelscope.operators.quantiles import Known, feature_quantiles
from labelscope.roles import Roles


def medians(df: DataFrame, features: Sequence[str], known: Known | None = None) -> DataFrame:
    """``(fid, median)`` with exact, interpolated medians of present values."""
    return feature_quantiles(df, features, [0.5], ["median"], known).select("fid", "median")


def matrix_source(df: DataFrame, roles: Roles) -> tuple[DataFrame, list[str]]:
    """The table with its label as a number, and the columns of the matrix.

    The label is filled like everywhere else and stays among the columns even
    when it is stored as text.
    """
    filled = df.withColumn(roles.label, roles.target().cast("double"))
    return filled, roles.numeric(filled, keep=(roles.label,))


def median_impute(
    df: DataFrame,
    features: Sequence[str],
    keep: Sequence[str] = (),
    middle: DataFrame | None = None,
) -> DataFrame:
    """``keep`` columns as they are, features as double with nulls at the median.

    A feature without any value stays null. ``middle`` is a stored result of
    :func:`medians`, for tables that are read more than once.
    """
    middle = medians(df, features) if middle is None else middle
    known = with_per_feature(df, "_m", middle, features, "median")
    filled = [
        f"coalesce({double_sql(df, c)}, _m.median_{i}) AS {quoted(c)}"
        for i, c in enumerate(features)
    ]
    return known.selectExpr(*[quoted(k) for k in keep], *filled)


def imputed_long(
    df: DataFrame, features: Sequence[str], *keep: Column, middle: DataFrame | None = None
) -> DataFrame:
    """``(keep…, fid, value, median)`` with null values at the median."""
    middle = medians(df, features) if middle is None else middle
    long = numeric_long(df, features, *keep).join(F.broadcast(middle), "fid")
    return long.withColumn("value", F.coalesce("value", "median"))


def outlier_limits(
    df: DataFrame, features: Sequence[str], known: Known | None = None
) -> DataFrame:
    """``(fid, median, mean, std)`` of the imputed features.

    Mean and variance follow from the present values and the number of nulls
    filled with the median, so no second look at the rows is needed.
    """
    long = numeric_long(df, features)
    present = long.groupBy("fid").agg(
        F.count("*").alias("n"),
        F.count("value").alias("k"),
        F.avg("value").alias("m"),
        F.var_pop("value").alias("v"),
    )
    n, k, m, v = F.col("n"), F.col("k"), F.col("m"), F.col("v")
    filled, middle = n - k, F.col("median")
    mean = (k * m + filled * middle) / n
    # spread inside the present values, plus the distance of the two groups
    squares = k * v + k * filled / n * (m - middle) * (m - middle)
    return present.join(medians(df, features, known), "fid").select(
        "fid",
        "median",
        mean.alias("mean"),
        F.sqrt(F.try_divide(squares, (n - 1).cast("double"))).alias("std"),
    )


def outlier_counts(df: DataFrame, features: Sequence[str], n_std: float = 5) -> DataFrame:
    """Per imputed feature: mean, std, and values more than n_std stds away."""
    # one row per feature
    limits = F.broadcast(outlier_limits(df, features))
    value = F.coalesce("value", "median")
    far = F.abs(value - F.col("mean")) > n_std * F.col("std")
    return (
        numeric_long(df, features)
        .join(limits, "fid")
        .groupBy("fid")
        .agg(
            F.max("mean").alias("mean"),
            F.max("std").alias("std"),
            F.count_if(far).alias("n_outliers"),
        )
        .select(feature_name(features).alias("feature"), "mean", "std", "n_outliers")
    )
