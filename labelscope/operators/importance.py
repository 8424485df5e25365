"""Ordinal encoding and random-forest importance over repeated seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.functions.columns import quoted, uniform_hash
from labelscope.operators import encoding
from labelscope.operators.encoding import category_codes
from labelscope.operators.forest import forest_importances
from labelscope.operators.impute import median_impute, medians
from labelscope.operators.longform import numeric_long
from labelscope.operators.quantiles import Known
from labelscope.roles import Roles
from labelscope.sources.scratch import materialize, temporary_tables
from labelscope.together import together

# Forest settings.
SEEDS = 5
TREES = 50
DEPTH = 10
# Fits that run side by side, and the rows that these hold at most: each keeps its
# own copy of the fitted rows and of their nodes at three levels, about 1 KB a row,
# and reads it once per level.
FITS_AT_ONCE = 5
HELD_ROWS = 5_000_000
# Tables of more rows are not fitted by Spark ML, which takes some 400 ns of CPU time for a
# row, tree and level, but by counts of bins.
ML_ROWS = 5_000_000
# How codes are looked up, see the module of the encoding.
BROADCAST_CODES = encoding.BROADCAST_CODES
BROADCAST_BYTES = encoding.BROADCAST_BYTES
FREQUENT = encoding.FREQUENT

__all__ = [
    "category_codes",
    "importance_comparison",
    "model_table",
    "ordinal_encode",
    "rf_importance",
    "rf_importance_by_seed",
]


def ordinal_encode(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The table with the listed features replaced by their codes, as double."""
    return encoding.ordinal_encode(df, features, BROADCAST_CODES, BROADCAST_BYTES, FREQUENT)


def model_table(
    df: DataFrame, roles: Roles, known: Known | None = None
) -> tuple[DataFrame, list[str]]:
    """Features as doubles without nulls, the 0/1 label and a balancing weight.

    Numeric features without any value are left out.
    """
    features = roles.features(df)
    numeric, other = roles.numeric(df), roles.categorical(df)
    label = roles.target().cast("double").alias("_label")
    if numeric:
        present = numeric_long(df, numeric).groupBy("fid").agg(F.count("value").alias("n"))
        used = {numeric[r.fid] for r in present.where(F.col("n") > 0).collect()}
        features = [c for c in features if c in used or c not in numeric]
        numeric = [c for c in numeric if c in used]
    encoded = ordinal_encode(df.select(label, *[F.col(quoted(c)) for c in features]), other)
    filled = encoded
    if numeric:
        middle = medians(df, numeric, known)
        filled = median_impute(encoded, numeric, ["_label", *other], middle)
    bad = F.count_if(F.col("_label") == 1)
    size = df.select(label).agg(F.struct(F.count("*").alias("n"), bad.alias("bad")).alias("t"))
    own = F.when(F.col("_label") == 1, F.col("_t.bad")).otherwise(F.col("_t.n") - F.col("_t.bad"))
    weight = F.col("_t.n") / (2.0 * own)
    weighted = filled.withColumn("_t", size.scalar())
    columns = [F.col(quoted(c)) for c in features]
    return weighted.select("_label", weight.alias("_weight"), *columns), features


def rf_importance_by_seed(
    df: DataFrame,
    roles: Roles,
    seeds: int = SEEDS,
    trees: int = TREES,
    depth: int = DEPTH,
    fit_rows: int | None = None,
    known: Known | None = None,
) -> DataFrame:
    """``(seed, feature, importance)``; the importances of a seed sum to 1.

    ``fit_rows`` bounds the rows that the forests are fitted on: about so many
    are drawn by a hash of the row, the same share of each class. Codes,
    medians and class weights always come from the whole table. Without it the
    forests are fitted on all rows. The seeds share one stored table and are
    fitted side by side as long as their copies of its rows are small, and else one
    after the other, so that a copy stays in memory for all levels. That changes no
    forest. Above ``ML_ROWS`` rows all seeds are grown together by :mod:`forest`:
    as many trees of the same kind on all rows, by other draws.
    """
    spark = df.sparkSession
    with temporary_tables(spark):
        prepared, features = model_table(df, roles, known)
        if not features:
            return spark.createDataFrame([], "seed int, feature string, importance double")
        if fit_rows is not None:
            share = min(1.0, fit_rows / max(1, df.count()))
            prepared = prepared.where(uniform_hash(prepared.columns, 42) < share)
        # Spark ML reads a dot in a name as a field
        inputs = [f"x{i}" for i in range(len(features))]
        table = materialize(prepared.toDF("_label", "_weight", *inputs), "model")
        assembled = VectorAssembler(inputCols=inputs, outputCol="_x").transform(table)
        assembled = assembled.select("_x", "_label", "_weight")

        def importances(seed: int) -> list[float]:
            forest = RandomForestClassifier(
                featuresCol="_x",
                labelCol="_label",
                weightCol="_weight",
                numTrees=trees,
                maxDepth=depth,
                cacheNodeIds=True,
                checkpointInterval=-1,
                seed=seed,
            )
            return [float(v) for v in forest.fit(assembled).featureImportances.toArray()]

        n = table.count()
        if n > ML_ROWS:
            fitted = forest_importances(table, inputs, range(seeds), trees, depth)
        else:
            at_once = max(1, min(FITS_AT_ONCE, HELD_ROWS // max(1, n)))
            fitted = together(spark, importances, range(seeds), at_once)
        rows = [(s, f, v) for s, own in enumerate(fitted) for f, v in zip(features, own, strict=True)]
    return spark.createDataFrame(rows, "seed int, feature string, importance double")


def rf_importance(by_seed: DataFrame) -> DataFrame:
    """Mean and sample std of the importance over the seeds, highest mean first."""
    return (
        by_seed.groupBy("feature")
        .agg(
            F.avg("importance").alias("rf_importance_mean"),
            F.stddev_samp("importance").alias("rf_importance_std"),
        )
        .orderBy(F.desc("rf_importance_mean"), "feature")
    )


def importance_comparison(
    iv: DataFrame, rf: DataFrame, top: int | None = 30, order_by: str = "iv"
) -> DataFrame:
    """Information Value beside forest importance, each also as a share of its maximum."""
    iv_max = iv.agg(F.max("iv")).scalar()
    rf_max = rf.agg(F.max("rf_importance_mean")).scalar()
    joined = (
        iv.join(rf, "feature")
        .withColumn("iv_norm", F.try_divide(F.col("iv"), iv_max))
        .withColumn("rf_norm", F.try_divide(F.col("rf_importance_mean"), rf_max))
        .orderBy(F.desc(order_by), "feature")
    )
    return joined if top is None else joined.limit(top)
