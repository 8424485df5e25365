"""The whole set of reports over one table, written to a folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from labelscope.operators.correlation import (
    high_pairs,
    matrix_wide,
    pearson_matrix,
    scatter_pairs,
    spearman_matrix,
)
from labelscope.operators.describe import (
    PERCENTILES,
    categorical_describe,
    numeric_summary,
    summarised,
)
from labelscope.operators.distribution import (
    CLIP,
    category_rates,
    class_means,
    clip_bounds,
    density_histogram,
    kde_curve,
)
from labelscope.operators.importance import (
    importance_comparison,
    rf_importance,
    rf_importance_by_seed,
)
from labelscope.operators.impute import matrix_source
from labelscope.operators.information import decile_cuts, information_values
from labelscope.operators.missing import missing_stats
from labelscope.operators.quantiles import Known, known_quantiles
from labelscope.operators.trend import (
    age_bin_bootstrap,
    age_bin_rates,
    lookback_columns,
    monthly_stats,
    scatter_age_accounts,
    window_histogram,
    window_volume_stats,
)
from labelscope.plans.retention import retention_report
from labelscope.roles import Roles
from labelscope.sources.reports import publish, read_report, write_report
from labelscope.sources.scratch import temporary_tables

Write = Callable[[str, DataFrame], DataFrame]

# The reports that hold rows of the table and not one per feature.
POINTS = ("total_accts_vs_relationship", "correlations/points")


def _writer(out: str) -> Write:
    """Write a report as CSV and hand back the stored rows."""

    def write(name: str, df: DataFrame) -> DataFrame:
        path = write_report(df, f"{out}/{name}", single_file=name not in POINTS)
        return read_report(df.sparkSession, path, df.schema)

    return write


def missing_report(df: DataFrame, roles: Roles, out: str) -> DataFrame:
    return _writer(out)("missing_rates", missing_stats(df, roles))


def summary_report(
    df: DataFrame, roles: Roles, out: str, method: str = "exact", known: Known | None = None
) -> None:
    write = _writer(out)
    write("basic_stats_numeric_features", numeric_summary(df, roles, method, known=known))
    write("basic_stats_categorical_features", categorical_describe(df, roles))


def trend_report(
    df: DataFrame,
    roles: Roles,
    out: str,
    keys: Sequence[str],
    age: str = "max_open_age",
    accounts: str = "total_accts",
) -> None:
    write = _writer(out)
    if roles.date in df.columns and roles.booked in df.columns:
        write("monthly_high_level_stats", monthly_stats(df, roles))
    if age in df.columns:
        write("relationship_age_fraud_stats", age_bin_rates(df, roles, age))
        write("fraud_dist_by_relationship_length", age_bin_bootstrap(df, roles, age))
        if accounts in df.columns:
            points = scatter_age_accounts(df, roles, list(keys), age, accounts)
            write("total_accts_vs_relationship", points)
    if lookback_columns(df):
        write("application_volume_stats", window_volume_stats(df))
        write("application_volume_histogram", window_histogram(df))


def distribution_report(
    df: DataFrame, roles: Roles, out: str, known: Known | None = None
) -> None:
    write = _writer(f"{out}/distribution_by_fraud")
    write("clip_bounds", clip_bounds(df, roles, known))
    write("class_means", class_means(df, roles))
    write("density", density_histogram(df, roles, "auto"))
    write("density_curves", kde_curve(df, roles))
    write("category_rates", category_rates(df, roles))


def correlation_report(
    df: DataFrame, roles: Roles, out: str, keys: Sequence[str], known: Known | None = None
) -> None:
    write = _writer(out)
    _, features = matrix_source(df, roles)
    pearson = write("correlation_long_pearson", pearson_matrix(df, roles, known))
    spearman = write("correlation_long_spearman", spearman_matrix(df, roles, known))
    write("correlation_all_features_pearson", matrix_wide(pearson, features))
    write("correlation_all_features_spearman", matrix_wide(spearman, features))
    found = write("correlation_high_pairs", high_pairs(pearson, spearman, features))
    # the stored pair list: at most one row per two features
    pairs = [(r.feat1, r.feat2) for r in found.select("feat1", "feat2").collect()]
    pairs = [p for p in pairs if roles.label not in p]
    if pairs:
        write("correlations/points", scatter_pairs(df, roles, pairs, keys, known=known))


def importance_report(
    df: DataFrame, roles: Roles, out: str, known: Known | None = None, **forest: int
) -> DataFrame:
    """The importance reports; the stored Information Values are handed back."""
    write = _writer(f"{out}/feature_importance")
    iv = write("information_values", information_values(df, roles, known=known))
    by_seed = rf_importance_by_seed(df, roles, known=known, **forest)
    rf = write("rf_feature_importance", rf_importance(by_seed))
    write("iv_vs_rf", importance_comparison(iv, rf))
    return iv


def full_report(df: DataFrame, roles: Roles, out: str, keys: Sequence[str], **forest: int) -> None:
    """Every report; store ``df`` as a table first, it is scanned many times.

    Reports whose columns the table doesn't have are left out: those by month
    without a date, by age without an age, of look-backs without any.
    """
    with temporary_tables(df.sparkSession):
        # one search for the percentiles, clip bounds, medians and bin edges of all reports
        wanted = [*PERCENTILES.values(), *CLIP, 0.5, *decile_cuts()]
        known = known_quantiles(df, summarised(df, roles)[0], wanted)
        missing = missing_report(df, roles, out)
        summary_report(df, roles, out, known=known)
        trend_report(df, roles, out, keys)
        distribution_report(df, roles, out, known)
        correlation_report(df, roles, out, keys, known)
        values = importance_report(df, roles, out, known, **forest)
        _writer(out)("retention", retention_report(missing, values))


def published_full_report(
    df: DataFrame, roles: Roles, out: str, keys: Sequence[str], **forest: int
) -> str:
    """:func:`full_report` as a run that readers see as a whole or not at all.

    ``sources.published_report`` reads a report of the last complete run.
    Returns the folder of this run.
    """
    return publish(
        df.sparkSession, out, lambda run: full_report(df, roles, run, keys, **forest)
    )
