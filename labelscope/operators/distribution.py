"""Class-conditional densities and category rates, for all features at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.binning import width_index
from labelscope.functions.columns import ratio
from labelscope.operators.longform import feature_name, numeric_long, text_long
from labelscope.operators.quantiles import Known, clip_range, feature_quantiles, quantiles
from labelscope.roles import Roles

# Clipping probabilities, category limit, curve points.
CLIP = (0.01, 0.99)
TOP_CATEGORIES = 20
GRID_POINTS = 200


def clip_bounds(df: DataFrame, roles: Roles, known: Known | None = None) -> DataFrame:
    """``(feature, lower, upper)``: exact 1 % and 99 % quantiles."""
    features = roles.numeric(df)
    q = feature_quantiles(df, features, CLIP, ["lower", "upper"], known)
    return q.select(feature_name(features).alias("feature"), "lower", "upper")


def class_means(df: DataFrame, roles: Roles) -> DataFrame:
    """``(feature, mean_0, mean_1)`` over all rows, outliers included."""
    features = roles.numeric(df)
    y, value = F.col("y"), F.col("value")
    return (
        numeric_long(df, features, roles.target().alias("y"))
        .groupBy("fid")
        .agg(
            F.avg(F.when(y == 0, value)).alias("mean_0"),
            F.avg(F.when(y == 1, value)).alias("mean_1"),
        )
        .select(feature_name(features).alias("feature"), "mean_0", "mean_1")
    )


def _clipped(df: DataFrame, roles: Roles, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Clipped ``(y, fid, value)`` rows, and ``(fid, first, last, n)`` of them."""
    long = numeric_long(df, features, roles.target().alias("y"))
    span = clip_range(long, *CLIP, len(features))
    inside = F.col("value").between(F.col("first"), F.col("last"))
    rows = long.join(F.broadcast(span), "fid").where(inside)
    return rows, span


def _auto_bins(rows: DataFrame, span: DataFrame, features: int) -> DataFrame:
    """Bin counts by the narrower of the Sturges and Freedman–Diaconis widths."""
    spread = quantiles(rows, [0.25, 0.75], features, ["q25", "q75"]).drop("n")
    width = F.col("last") - F.col("first")
    sturges = width / (F.log2("n") + 1)
    freedman = 2 * (F.col("q75") - F.col("q25")) / F.cbrt("n")
    step = F.when(freedman > 0, F.least(freedman, sturges)).otherwise(sturges)
    bins = F.when(width > 0, F.ceil(width / step)).otherwise(F.lit(1).cast("bigint"))
    return span.join(spread, "fid").withColumn("bins", bins).drop("q25", "q75")


def density_histogram(df: DataFrame, roles: Roles, bins: int | str = 30) -> DataFrame:
    """``(feature, label, bin, bin_low, bin_high, n, density)`` of clipped values.

    The bins are shared by the classes and the area of each class is 1. Pass
    ``bins="auto"`` to choose the number per feature from its spread. A feature
    with a single value gets bins across half a unit on either side.
    """
    features = roles.numeric(df)
    rows, span = _clipped(df, roles, features)
    rows = rows.select("y", "fid", "value")
    if bins == "auto":
        span = _auto_bins(rows, span, len(features))
    else:
        span = span.withColumn("bins", F.lit(bins).cast("bigint"))
    flat = F.when(F.col("first") == F.col("last"), 0.5).otherwise(0.0)
    frame = span.select(
        "fid", (F.col("first") - flat).alias("low"), (F.col("last") + flat).alias("high"), "bins"
    )
    low, step = F.col("low"), (F.col("high") - F.col("low")) / F.col("bins")
    at = width_index(F.col("value"), low, F.col("high"), F.col("bins"))
    by_class = Window.partitionBy("fid", "label")
    return (
        rows.join(F.broadcast(frame), "fid")
        .groupBy("fid", F.col("y").alias("label"), at.alias("bin"))
        .agg(F.count("*").alias("n"), F.max("low").alias("low"), F.max(step).alias("step"))
        .withColumn("density", F.col("n") / (F.sum("n").over(by_class) * F.col("step")))
        .select(
            feature_name(features).alias("feature"),
            "label",
            "bin",
            (low + F.col("step") * F.col("bin")).alias("bin_low"),
            (low + F.col("step") * (F.col("bin") + 1)).alias("bin_high"),
            "n",
            "density",
        )
    )


def kde_curve(
    df: DataFrame, roles: Roles, points: int = GRID_POINTS, cells: int = 4096
) -> DataFrame:
    """``(feature, label, point, x, density)``: Gaussian density curve per class.

    Scott's bandwidth, ``points`` positions across the clipped range. Values are
    first gathered into ``cells`` fine cells, each represented by its count and
    mean, so the curve costs cells × points steps per class at any table size.
    Classes without spread have no curve.
    """
    features = roles.numeric(df)
    rows, _ = _clipped(df, roles, features)
    offset = F.col("value") - F.col("first")
    binned = (
        rows.where(F.col("first") < F.col("last"))
        .withColumn("cell", width_index(F.col("value"), F.col("first"), F.col("last"), cells))
        .withColumn("offset", offset)
        .groupBy("fid", F.col("y").alias("label"), "cell")
        .agg(
            F.count("*").alias("w"),
            F.avg("offset").alias("centre"),
            F.sum("offset").alias("s1"),
            F.sum(F.col("offset") * F.col("offset")).alias("s2"),
            F.max("first").alias("first"),
            F.max("last").alias("last"),
        )
    )
    # at most `cells` rows per class
    by_class = Window.partitionBy("fid", "label")
    n = F.sum("w").over(by_class)
    s1, s2 = F.sum("s1").over(by_class), F.sum("s2").over(by_class)
    variance = F.try_divide(s2 - s1 * s1 / n, (n - 1).cast("double"))
    prepared = (
        binned.withColumn("n", n)
        .withColumn("h", F.sqrt(F.greatest(variance, F.lit(0.0))) * F.pow(n.cast("double"), F.lit(-0.2)))
        .where(F.col("h") > 0)
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("at", (F.col("last") - F.col("first")) * F.col("point") / (points - 1))
    )
    z = (F.col("at") - F.col("centre")) / F.col("h")
    mass = F.sum(F.col("w") * F.exp(-0.5 * z * z))
    scale = F.max(F.col("n") * F.col("h")) * math.sqrt(2 * math.pi)
    return (
        prepared.groupBy("fid", "label", "point")
        .agg(F.max(F.col("first") + F.col("at")).alias("x"), (mass / scale).alias("density"))
        .select(feature_name(features).alias("feature"), "label", "point", "x", "density")
    )


def value_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """``(feature, value, count)`` of present values, as text."""
    return _counted(df, features, F.lit(0)).select(
        feature_name(features).alias("feature"), "value", F.col("volume").alias("count")
    )


def _counted(df: DataFrame, features: list[str], y: Column) -> DataFrame:
    return (
        text_long(df, features, y.alias("y"))
        .where(F.col("value").isNotNull())
        .groupBy("fid", "value")
        .agg(F.count("*").alias("volume"), F.sum("y").cast("bigint").alias("bad"))
    )


def category_rates(
    df: DataFrame, roles: Roles, features: list[str] | None = None, top: int = TOP_CATEGORIES
) -> DataFrame:
    """Volume and label rate of the ``top`` most frequent values per feature.

    ``n_categories`` is the number of distinct values before the cut. Equal
    volumes are ordered by value.
    """
    features = features or roles.categorical(df)
    counted = _counted(df, features, roles.target())
    sizes = counted.groupBy("fid").agg(F.count("*").alias("n_categories"))
    order = Window.partitionBy("fid").orderBy(F.desc("volume"), "value")
    best = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    # one row per feature
    return (
        best.join(F.broadcast(sizes), "fid")
        .orderBy("fid", "place")
        .select(
            feature_name(features).alias("feature"),
            "value",
            "volume",
            ratio(F.col("bad"), F.col("volume")).alias("fraud_rate"),
            "n_categories",
        )
    )
