"""Monthly volumes, label rate by relationship age, look-back counts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.functions.binning import interval_label, unit_bin
from labelscope.functions.columns import as_double, parse_date, quoted, ratio
from labelscope.operators.longform import numeric_long
from labelscope.operators.sampling import cap_rows
from labelscope.roles import Roles

# Age bins in years, right-closed, and their labels.
AGE_EDGES = (0, 0.5, 1, 2, 999)
AGE_LABELS = ("new_custs_<6mo", "newish_6mo_1y", "somewhat_new_1y_2y", "established_>2y")
# Fixed value: look-back histograms stop at this many applications.
HISTOGRAM_TOP = 29


def monthly_stats(df: DataFrame, roles: Roles) -> DataFrame:
    """Per month: volume, booked and label sums, and their rates.

    Rows without a valid date form one group with a null month.
    """
    month = F.trunc(parse_date(df, roles.date), "MM")
    apps = F.col("total_apps")
    return (
        df.select(
            month.alias("month_start"), F.col(roles.booked).alias("b"), roles.target().alias("y")
        )
        .groupBy("month_start")
        .agg(
            F.count("*").alias("total_apps"),
            F.sum("b").alias("total_booked"),
            F.sum("y").alias("total_fraud"),
        )
        .withColumn("booked_rate", ratio(F.col("total_booked"), apps))
        .withColumn("fraud_rate", ratio(F.col("total_fraud"), apps))
        .orderBy("month_start")
    )


def _age_counts(df: DataFrame, roles: Roles, age: str, include_lowest: bool) -> DataFrame:
    label = interval_label(as_double(df, age), AGE_EDGES, AGE_LABELS, include_lowest)
    return (
        df.select(label.alias("relat_age_bin"), roles.target().alias("y"))
        .where(F.col("relat_age_bin").isNotNull())
        .groupBy("relat_age_bin")
        .agg(F.count("*").alias("count"), F.sum("y").alias("fraud_count"))
        .withColumn("fraud_rate", ratio(F.col("fraud_count"), F.col("count")))
    )


def _in_age_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.array_position(F.array(*[F.lit(x) for x in AGE_LABELS]), F.col("relat_age_bin")))


def age_bin_rates(
    df: DataFrame, roles: Roles, age: str = "max_open_age", include_lowest: bool = False
) -> DataFrame:
    """Rows, label sum and label rate per relationship-age bin.

    The bins are right-closed, so an age of exactly 0 is in none of them unless
    ``include_lowest`` is set.
    """
    return _in_age_order(_age_counts(df, roles, age, include_lowest))


def age_bin_wilson(
    df: DataFrame, roles: Roles, age: str = "max_open_age", z: float = 1.959963984540054
) -> DataFrame:
    """:func:`age_bin_rates` with a Wilson interval for the rate, in closed form."""
    n, p = F.col("count").cast("double"), F.col("fraud_rate")
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    rates = _age_counts(df, roles, age, False)
    return _in_age_order(
        rates.withColumn("rate_low", centre - half).withColumn("rate_high", centre + half)
    )


def age_bin_bootstrap(
    df: DataFrame,
    roles: Roles,
    age: str = "max_open_age",
    replicates: int = 1000,
    level: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """:func:`age_bin_rates` with a bootstrap interval for the rate.

    The label is 0 or 1, so the mean of n rows drawn with replacement is a
    binomial count over n. Replicates are therefore drawn from the bin counts,
    and the rows are read once.
    """
    tail = (1 - level) / 2

    def intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            bounds = []
            for row in batch.itertuples():
                bin_no = AGE_LABELS.index(row.relat_age_bin)
                draws = np.random.default_rng([seed, bin_no]).binomial(
                    row.count_, row.fraud_rate, replicates
                )
                bounds.append(np.quantile(draws / row.count_, [tail, 1 - tail]))
            low_high = np.array(bounds).reshape(len(batch), 2)
            yield batch.assign(rate_low=low_high[:, 0], rate_high=low_high[:, 1])

    rates = _age_counts(df, roles, age, False).withColumnRenamed("count", "count_")
    schema = (
        "relat_age_bin string, count_ bigint, fraud_count bigint, fraud_rate double, "
        "rate_low double, rate_high double"
    )
    return _in_age_order(rates.mapInPandas(intervals, schema).withColumnRenamed("count_", "count"))


def lookback_columns(df: DataFrame, prefix: str = "total_apps_in_last_") -> dict[int, str]:
    """Window length in days → column, for look-back columns named by the prefix.

    ``total_apps_in_last_90`` and ``total_apps_in_last_90_days`` both match;
    other columns that merely contain ``last_90`` do not.
    """
    pattern = re.compile(re.escape(prefix) + r"(\d+)(_days)?$")
    found: dict[int, str] = {}
    for name in df.columns:
        if match := pattern.match(name):
            found.setdefault(int(match.group(1)), name)
    return dict(sorted(found.items()))


def window_volume_stats(df: DataFrame, prefix: str = "total_apps_in_last_") -> DataFrame:
    """Mean, maximum and number of zeros of each look-back count."""
    windows = lookback_columns(df, prefix)
    labels = F.array(*[F.lit(f"{days}_days") for days in windows]).cast("array<string>")
    return (
        numeric_long(df, list(windows.values()))
        .groupBy("fid")
        .agg(
            F.avg("value").alias("avg_apps"),
            F.max("value").alias("max_apps"),
            F.count_if(F.col("value") == 0).alias("zero_count"),
        )
        .orderBy("fid")
        .select(F.get(labels, F.col("fid")).alias("window"), "avg_apps", "max_apps", "zero_count")
    )


def window_histogram(
    df: DataFrame, prefix: str = "total_apps_in_last_", top: int = HISTOGRAM_TOP
) -> DataFrame:
    """Unit-width histogram of each look-back count above 0 and up to ``top``.

    The last bin is [top - 1, top].
    """
    windows = lookback_columns(df, prefix)
    labels = F.array(*[F.lit(f"{days}_days") for days in windows]).cast("array<string>")
    return (
        numeric_long(df, list(windows.values()))
        .where((F.col("value") > 0) & (F.col("value") <= top))
        .groupBy("fid", unit_bin(F.col("value"), top - 1).alias("bin"))
        .agg(F.count("*").alias("count"))
        .select(F.get(labels, F.col("fid")).alias("window"), "bin", "count")
    )


def scatter_age_accounts(
    df: DataFrame,
    roles: Roles,
    keys: Sequence[str] = (),
    age: str = "max_open_age",
    accounts: str = "total_accts",
    cap: int = 50_000,
    seed: int = 42,
    portable: bool = False,
) -> DataFrame:
    """(keys…, age, accounts, label) points, min(cap, rows) of them, unbiased.

    ``keys`` are shown beside each point and need not be unique.
    """
    columns = [F.col(quoted(c)) for c in (*keys, age, accounts)]
    points = df.select(*columns, roles.target().alias(roles.label))
    return cap_rows(points, cap, keys or None, seed, portable)
