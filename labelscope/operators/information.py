"""Weight of evidence and Information Value for every feature in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.binning import edge_index
from labelscope.operators.longform import feature_name, numeric_long, text_long
from labelscope.operators.quantiles import Known, feature_quantiles
from labelscope.roles import Roles

# Smoothing of counts, and the largest number of bins.
EPSILON = 1e-6
MAX_BINS = 10
MISSING = "Missing"


def iv_bins(
    df: DataFrame,
    roles: Roles,
    bins: int = MAX_BINS,
    missing: str = "bin",
    binning: str = "quantile",
    known: Known | None = None,
) -> DataFrame:
    """``(feature, bin, good, bad, woe, iv)`` for every bin of every feature.

    Numeric features with more than ``bins`` distinct values are cut at exact
    quantiles (or at equal widths with ``binning="width"``); the bins are
    right-closed and named by their index. All other features have one bin per
    value. Missing values form the bin ``Missing``; with ``missing="drop"``
    they are left out of the cut features, as older crosstabs do.
    """
    if missing not in ("bin", "drop"):
        raise ValueError(f"unknown missing policy {missing!r}")
    y = roles.target().alias("y")
    totals = df.select(y).agg(
        F.struct(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("bad")).alias("t")
    )
    parts = []
    if numeric := roles.numeric(df):
        long = numeric_long(df, numeric, y)
        cuts = None
        if binning == "quantile":
            probs, names = decile_cuts(bins), [f"q{k}" for k in range(bins + 1)]
            cuts = feature_quantiles(df, numeric, probs, names, known)
        elif binning != "width":
            raise ValueError(f"unknown binning {binning!r}")
        counted = _numeric_counts(long, bins, missing, cuts)
        parts.append(counted.withColumn("feature", feature_name(numeric)))
    other = roles.categorical(df)
    if other or not numeric:
        counted = (
            text_long(df, other, y)
            .groupBy("fid", F.coalesce("value", F.lit(MISSING)).alias("bin"))
            .agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("bad"))
            .withColumn("cut_n", F.lit(None).cast("bigint"))
            .withColumn("cut_bad", F.lit(None).cast("bigint"))
        )
        parts.append(counted.withColumn("feature", feature_name(other)))
    counted = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    counted = counted.withColumn("t", totals.scalar())
    n_all = F.coalesce("cut_n", "t.n")
    bad_all = F.coalesce("cut_bad", "t.bad")
    good = F.col("n") - F.col("bad")
    dist_good = (good + EPSILON) / (n_all - bad_all + EPSILON)
    dist_bad = (F.col("bad") + EPSILON) / (bad_all + EPSILON)
    woe = F.ln(dist_good / dist_bad)
    return counted.select(
        "feature",
        "bin",
        good.alias("good"),
        "bad",
        woe.alias("woe"),
        ((dist_good - dist_bad) * woe).alias("iv"),
    )


def information_values(
    df: DataFrame,
    roles: Roles,
    bins: int = MAX_BINS,
    missing: str = "bin",
    binning: str = "quantile",
    known: Known | None = None,
) -> DataFrame:
    """``(feature, iv, n_bins)`` for every feature, highest value first."""
    return (
        iv_bins(df, roles, bins, missing, binning, known)
        .groupBy("feature")
        .agg(F.sum("iv").alias("iv"), F.count("*").alias("n_bins"))
        .orderBy(F.desc("iv"), "feature")
    )


def decile_cuts(bins: int = MAX_BINS) -> list[float]:
    """The probabilities at which a feature is cut."""
    return [k / bins for k in range(bins + 1)]


def _numeric_counts(
    long: DataFrame, bins: int, missing: str, cuts: DataFrame | None
) -> DataFrame:
    """Counts per bin, cut at the given quantiles or else at equal widths."""
    value = F.col("value")
    # A HyperLogLog estimate cannot exceed the number of values by much while
    # so few registers are set, so a high estimate proves "more than bins".
    # Only the features it leaves open are counted value by value.
    profile = long.groupBy("fid").agg(
        F.approx_count_distinct("value").alias("about"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.count("value").alias("present"),
        F.sum(F.when(value.isNotNull(), F.col("y"))).cast("bigint").alias("bad_present"),
    )
    if cuts is not None:
        # edges equal to an earlier one, or to the minimum, bound no bin
        edges = [f"if(q{k} > q{k - 1}, q{k}, null) AS e{k}" for k in range(1, bins)]
        info = profile.join(cuts.selectExpr("fid", *edges), "fid", "left")
    else:
        edges = [f"low + (high - low) / {bins} * {k} AS e{k}" for k in range(1, bins)]
        info = profile.selectExpr("*", *edges)
    edge_cols = [f"e{k}" for k in range(1, bins)]
    carried = ["about", "present", "bad_present"]
    # one row per feature
    info = F.broadcast(info.select("fid", *carried, *edge_cols))

    open_case = F.col("about") <= 2 * bins
    index = edge_index("value", edge_cols)
    binned = (
        long.join(info, "fid")
        .withColumn("bin", F.when(value.isNotNull(), index))
        .withColumn("level", F.when(open_case, value))
        .groupBy("fid", "bin", "level")
        .agg(
            F.count("*").alias("n"),
            F.sum("y").cast("bigint").alias("bad"),
            *[F.max(c).alias(c) for c in carried],
        )
    )
    # at most 2 * bins levels, or bins + 1 bins, per feature from here on
    levels = F.count("level").over(Window.partitionBy("fid"))
    by_value = open_case & (F.col("levels") <= bins)
    absent = F.col("bin").isNull()
    name = (
        F.when(absent, MISSING)
        .when(by_value, F.col("level").cast("string"))
        .otherwise(F.col("bin").cast("string"))
    )
    counted = (
        binned.withColumn("levels", levels)
        .withColumn("by_value", by_value)
        .withColumn("name", name)
        .where(F.lit(missing == "bin") | F.col("by_value") | ~absent)
        .groupBy("fid", F.col("name").alias("bin"))
        .agg(
            F.sum("n").alias("n"),
            F.sum("bad").alias("bad"),
            F.max(_cut_total("present", missing)).alias("cut_n"),
            F.max(_cut_total("bad_present", missing)).alias("cut_bad"),
        )
    )
    return counted


def _cut_total(column: str, missing: str) -> Column:
    dropped = ~F.col("by_value") & F.lit(missing == "drop")
    return F.when(dropped, F.col(column))

