"""Queries for results that SQL cannot give, as relations that it can.

Each states what must hold of the result, so a violation shows as a row.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.columns import double_sql
from labelscope.operators import bootstrap, describe, distribution, importance, information, trend
from labelscope.operators.longform import feature_name, numeric_long
from labelscope.operators.sampling import bernoulli_sample
from labelscope.roles import Roles
from labelscope.sources import materialize, read_report, shared_folder, write_report

# The Arrow functions travel with their code, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sample_size(df: DataFrame, keys: list[str], fraction: float = 0.05) -> DataFrame:
    """Whether a Bernoulli sample is a part of the table, of about the wanted size."""
    drawn = bernoulli_sample(df, fraction).select(*keys)
    both = drawn.join(df.select(*keys, F.lit(1).alias("known")), keys, "left")
    n, m = F.count("*"), F.count("known")
    total = df.agg(F.count("*").alias("n")).scalar()
    wide = 5 * F.sqrt(total * fraction * (1 - fraction))
    return both.agg((n == m).alias("inside"), (F.abs(n - total * fraction) <= wide).alias("near"))


def sketch_ranks(df: DataFrame, roles: Roles, accuracy: int = 10_000) -> DataFrame:
    """``(feature, percentile, within)``: whether each sketched percentile has its rank.

    A percentile has to be a value of its feature. The smaller and the equal values
    are counted inside the tasks, so no feature has to be ordered.
    """
    features = describe.summarised(df, roles)[0]
    found = describe.numeric_percentiles(df, roles, features, "approx", accuracy)
    names = F.array(*[F.lit(f) for f in features]).cast("array<string>")
    fid = (F.array_position(names, F.col("feature")) - 1).cast("int").alias("fid")
    wanted = found.select(fid, "feature", *describe.PERCENTILES)
    rows = numeric_long(df, features).where("value is not null").join(F.broadcast(wanted), "fid")
    value = F.col("value")
    counted = rows.groupBy("feature").agg(
        F.count("*").alias("total"),
        *[F.max(n).alias(n) for n in describe.PERCENTILES],
        *[F.count_if(value < F.col(n)).alias(f"below_{n}") for n in describe.PERCENTILES],
        *[F.count_if(value <= F.col(n)).alias(f"upto_{n}") for n in describe.PERCENTILES],
    )
    each = [
        F.struct(
            F.lit(n).alias("percentile"),
            (F.lit(p) * F.col("total")).alias("rank"),
            F.col(n).alias("at"),
            F.col(f"below_{n}").alias("below"),
            F.col(f"upto_{n}").alias("upto"),
        )
        for n, p in describe.PERCENTILES.items()
    ]
    below, upto, rank = F.col("below"), F.col("upto"), F.col("rank")
    slack = F.ceil(F.col("total") / accuracy) + 1
    within = (below < upto) & (below <= rank + slack) & (upto >= rank - slack)
    return (
        counted.select("feature", "total", F.inline(F.array(*each)))
        .where("at is not null")
        .select("feature", "percentile", within.alias("within"))
    )


def bootstrap_brackets(df: DataFrame, roles: Roles) -> DataFrame:
    """Whether each bootstrap interval holds the rate and is near the closed form."""
    closed = trend.age_bin_wilson(df, roles).select(
        "relat_age_bin", F.col("rate_low").alias("low"), F.col("rate_high").alias("high")
    )
    rows = trend.age_bin_bootstrap(df, roles).join(closed, "relat_age_bin")
    rate = F.col("fraud_rate")
    holds = (F.col("rate_low") <= rate) & (rate <= F.col("rate_high"))
    width = F.col("high") - F.col("low")
    near = (F.abs(F.col("rate_low") - F.col("low")) <= 0.35 * width + 0.02) & (
        F.abs(F.col("rate_high") - F.col("high")) <= 0.35 * width + 0.02
    )
    return rows.select("relat_age_bin", holds.alias("holds"), near.alias("near"))


def mean_brackets(df: DataFrame, value: str, group: str, keys: list[str]) -> DataFrame:
    """Whether each bootstrap interval of a mean holds it and is near the normal interval."""
    found = bootstrap.bootstrap_means(df, value, group, keys)
    closed = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("own")).agg(
        F.avg(value).alias("m"),
        (1.959963984540054 * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("half"),
    )
    rows = found.join(closed, F.col(group).eqNullSafe(F.col("own")))
    holds = (F.col("mean_low") <= F.col("mean")) & (F.col("mean") <= F.col("mean_high"))
    slack = 0.35 * 2 * F.col("half") + 1e-9
    near = (F.abs(F.col("mean_low") - (F.col("m") - F.col("half"))) <= slack) & (
        F.abs(F.col("mean_high") - (F.col("m") + F.col("half"))) <= slack
    )
    same = F.abs(F.col("mean") - F.col("m")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("m"))
    return rows.select(group, "count", holds.alias("holds"), near.alias("near"), same.alias("same"))


#: Values whose kernels are added up at a time.
_KERNELS = 256


def _kernel_sums(curves: dict[tuple[int, int], tuple[float, float, float, np.ndarray]]):
    """The kernel sum of a task's rows at every point of the curves.

    A batch has the label and then the features. ``curves`` gives, by feature and
    label, the bounds of the values, the bandwidth and the points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {key: np.zeros(len(points)) for key, (*_, points) in curves.items()}
        for batch in batches:
            label, *columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for (fid, y), (lower, upper, h, points) in curves.items():
                values = columns[fid]
                values = values[(label == y) & (values >= lower) & (values <= upper)]
                for at in range(0, len(values), _KERNELS):
                    z = points[:, None] - values[None, at : at + _KERNELS]
                    z /= h
                    z *= z
                    z *= -0.5
                    sums[fid, y] += np.exp(z, out=z).sum(axis=1)
        for (fid, y), total in sums.items():
            n = len(total)
            columns = [np.full(n, fid, np.int32), np.full(n, y, np.int32), np.arange(n, dtype=np.int32), total]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["fid", "label", "point", "mass"])

    return run


def curve_error(df: DataFrame, roles: Roles, most: float = 1e-3) -> DataFrame:
    """Whether each density curve is near the plain kernel sum over all its rows.

    Every row adds its kernel at every point, inside the tasks; the curves are sent
    to them.
    """
    features = roles.numeric(df)
    label = roles.target().alias("label")
    curve = materialize(distribution.kde_curve(df, roles), "kde-curve")
    bounds = distribution.clip_bounds(df, roles)
    spread = (
        numeric_long(df, features, label)
        .select(feature_name(features).alias("feature"), "label", "value")
        .join(F.broadcast(bounds), "feature")
        .where(F.col("value").between(F.col("lower"), F.col("upper")))
        .groupBy("feature", "label", "lower", "upper")
        .agg(F.count("*").alias("n"), F.stddev_samp("value").alias("deviation"))
        .withColumn("h", F.col("deviation") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    )
    points = curve.groupBy("feature", "label").agg(
        F.sort_array(F.collect_list(F.struct("point", "x"))).alias("points")
    )
    wanted = materialize(spread.join(F.broadcast(points), ["feature", "label"]), "kde-points")
    # one row per feature and label
    curves = {
        (features.index(r.feature), r.label): (r.lower, r.upper, r.h, np.array([p.x for p in r.points]))
        for r in wanted.collect()
    }
    cells = [F.expr(double_sql(df, c)).alias(f"v{i}") for i, c in enumerate(features)]
    sums = df.select(label, *cells).mapInArrow(
        _kernel_sums(curves), "fid int, label int, point int, mass double"
    )
    plain = (
        sums.groupBy(feature_name(features).alias("feature"), "label", "point")
        .agg(F.sum("mass").alias("mass"))
        .join(F.broadcast(wanted.select("feature", "label", "n", "h")), ["feature", "label"])
        .withColumn("mass", F.col("mass") / (F.col("n") * F.col("h")) / math.sqrt(2 * math.pi))
        .join(F.broadcast(curve.drop("x")), ["feature", "label", "point"])
    )
    error = F.max(F.abs(F.col("density") - F.col("mass"))) / F.max("mass")
    return plain.groupBy("feature", "label").agg((error <= most).alias("near"))


def importance_sums(df: DataFrame, roles: Roles) -> DataFrame:
    """Per seed the number of features and the sum of their importances, as registered."""
    by_seed = importance.rf_importance_by_seed(df, roles)
    return by_seed.groupBy("seed").agg(
        F.count("*").alias("features"), F.sum("importance").alias("total")
    )


def given_importance(df: DataFrame, roles: Roles) -> DataFrame:
    """A stand-in for forest importance that SQL can state: the distance of class means."""
    means = distribution.class_means(df, roles)
    return means.select(
        "feature",
        F.abs(F.col("mean_1") - F.col("mean_0")).alias("rf_importance_mean"),
        F.lit(0.0).alias("rf_importance_std"),
    )


def compared(df: DataFrame, roles: Roles) -> DataFrame:
    """The 30 first of the comparison, on a given importance table."""
    iv = information.information_values(df, roles)
    return importance.importance_comparison(iv, given_importance(df, roles))


def importance_over_seeds(lines: DataFrame) -> DataFrame:
    """Mean and deviation over seeds of a given importance: shares of quantity."""
    by_seed = lines.groupBy(
        (F.col("l_linenumber") % 5).alias("seed"),
        F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("feature"),
    ).agg(F.sum("l_quantity").alias("importance"))
    whole = F.sum("importance").over(Window.partitionBy("seed"))
    shares = by_seed.withColumn("importance", F.col("importance") / whole)
    return importance.rf_importance(shares)


def written(df: DataFrame, single_file: bool = True) -> DataFrame:
    """A report written as CSV and read back."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/labelscope/{app}/report-{uuid.uuid4().hex[:12]}"
    return read_report(spark, write_report(df, path, single_file=single_file), df.schema)
