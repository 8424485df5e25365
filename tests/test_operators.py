"""Edge cases and comparisons with pandas on small frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelscope.operators.correlation import (
    high_pairs,
    matrix_wide,
    pearson_matrix,
    scatter_pairs,
    spearman_matrix,
)
from labelscope.operators.describe import (
    categorical_describe,
    numeric_describe,
    numeric_percentiles,
    numeric_summary,
)
from labelscope.operators.distribution import (
    category_rates,
    clip_bounds,
    density_histogram,
    kde_curve,
)
from labelscope.operators.impute import median_impute, outlier_counts
from labelscope.operators.information import information_values, iv_bins
from labelscope.operators.missing import missing_stats
from labelscope.operators.trend import (
    age_bin_bootstrap,
    age_bin_rates,
    lookback_columns,
    monthly_stats,
    window_histogram,
    window_volume_stats,
)
from labelscope.roles import Roles

ROLES = Roles(label="y", ignore=("id",))


def frame(spark, pdf, schema=None):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema)


def by_feature(df, key="feature"):
    return {row[key]: row for row in df.collect()}


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    n = 2000
    y = (rng.random(n) < 0.2).astype(int)
    x = rng.normal(0, 1, n) + y
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "y": y,
            "x": x,
            "twin": 2 * x + rng.normal(0, 0.2, n),
            "gaps": np.where(rng.random(n) < 0.5, np.nan, rng.exponential(2, n)),
            "skewed": np.where(rng.random(n) < 0.96, 0.0, rng.random(n)),
            "few": rng.integers(0, 3, n).astype(float),
            "ten": rng.integers(0, 10, n).astype(float),
            "eleven": rng.integers(0, 11, n).astype(float),
            "twenty": rng.integers(0, 20, n).astype(float),
            "colour": rng.choice(["red", "green", "blue"], n),
        }
    )
    pdf.loc[rng.random(n) < 0.1, "colour"] = None
    return pdf


@pytest.fixture(scope="module")
def table(spark, sample):
    schema = (
        "id bigint, y int, x double, twin double, gaps double, skewed double, few double, "
        "ten double, eleven double, twenty double, colour string"
    )
    return frame(spark, sample, schema).repartition(6).cache()


def pandas_iv(pdf, feature, keep_missing=True):
    values = pdf[feature]
    if values.dtype != object and values.nunique() > 10:
        bins = pd.qcut(values, 10, duplicates="drop").cat.codes
        bins = bins.where(bins >= 0) if not keep_missing else bins
    else:
        bins = values.astype(object).where(values.notna(), "Missing").astype(str)
    counts = pd.crosstab(bins, pdf["y"])
    good = (counts[0] + 1e-6) / (counts[0].sum() + 1e-6)
    bad = (counts[1] + 1e-6) / (counts[1].sum() + 1e-6)
    return float(((good - bad) * np.log(good / bad)).sum()), len(counts)


@pytest.mark.parametrize("policy", ["bin", "drop"])
def test_information_value_equals_pandas(table, sample, policy):
    found = by_feature(information_values(table, ROLES, missing=policy))
    assert set(found) == set(sample.columns) - {"id", "y"}
    for feature, row in found.items():
        iv, bins = pandas_iv(sample, feature, policy == "bin")
        assert math.isclose(row.iv, iv, rel_tol=1e-9), feature
        assert row.n_bins == bins, feature


def test_bins_hold_every_row_and_add_up(table):
    rows = iv_bins(table, ROLES).groupBy("feature").agg(F.sum(F.col("good") + F.col("bad")).alias("n"))
    assert {r.n for r in rows.collect()} == {2000}
    assert all(r.iv >= 0 for r in iv_bins(table, ROLES).collect())


def test_ten_values_are_categories_and_eleven_are_cut(table):
    names = {
        f: {r.bin for r in iv_bins(table, ROLES).where(F.col("feature") == f).collect()}
        for f in ("ten", "eleven", "twenty")
    }
    assert names["ten"] == {f"{k}.0" for k in range(10)}
    assert "0.0" not in names["eleven"] and "0.0" not in names["twenty"]


def test_one_class_gives_finite_values(spark):
    df = spark.createDataFrame([(i, 0, float(i)) for i in range(50)], "id int, y int, x double")
    assert math.isfinite(information_values(df, ROLES).first().iv)


def test_width_bins_equal_pandas_cut(table, sample):
    rows = iv_bins(table, ROLES, binning="width").where("feature = 'x'").collect()
    codes = pd.cut(sample["x"], 10).cat.codes.value_counts()
    assert {int(r.bin): r.good + r.bad for r in rows} == codes.to_dict()


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_matrix_equals_pandas(table, sample, method):
    numbers = sample.drop(columns=["id", "colour"])
    expected = numbers.fillna(numbers.median()).corr(method=method)
    found = (
        pearson_matrix(table, ROLES) if method == "pearson" else spearman_matrix(table, ROLES)
    )
    rows = found.collect()
    assert len(rows) == expected.size
    for r in rows:
        assert abs(r[method] - expected.loc[r.feat1, r.feat2]) < 1e-9
        assert abs(r[method]) <= 1


def test_spearman_with_ties(spark):
    pairs = zip([1, 2, 2, 3, 7], [4, 1, 1, 9, 2])
    rows = [(i, 0, a, b) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id int, y int, a int, b int")
    rows = {(r.feat1, r.feat2): r.spearman for r in spearman_matrix(df, ROLES).collect()}
    assert math.isclose(rows["a", "b"], 0.157894736842105, rel_tol=1e-12)


def test_spearman_ranks_inside_ranges(spark):
    # more distinct values than cut points, a hot value and ties between cuts
    rng = np.random.default_rng(2)
    n = 9000
    a = np.where(rng.random(n) < 0.35, 1.5, rng.normal(0, 1, n).round(3))
    pdf = pd.DataFrame({"id": range(n), "y": 0, "a": a, "b": a + rng.normal(0, 1, n)})
    df = spark.createDataFrame(pdf).repartition(7)
    rows = {(r.feat1, r.feat2): r.spearman for r in spearman_matrix(df, ROLES).collect()}
    expected = pdf[["a", "b"]].corr(method="spearman").loc["a", "b"]
    assert abs(rows["a", "b"] - expected) < 1e-12


def test_spearman_of_more_columns_than_a_slice(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.integers(0, 9, (60, 90)), columns=[f"c{i}" for i in range(90)])
    df = spark.createDataFrame(pdf.assign(id=range(60), y=0))
    expected = pdf.corr(method="spearman")
    for r in spearman_matrix(df, ROLES).where("feat1 = 'c3' and feat2 like 'c8%'").collect():
        assert abs(r.spearman - expected.loc[r.feat1, r.feat2]) < 1e-9


def test_constant_and_empty_columns_have_no_coefficient(spark):
    df = spark.createDataFrame(
        [(i, i % 2, float(i), 5.0, None) for i in range(20)],
        "id int, y int, x double, k double, e double",
    )
    for found in (pearson_matrix(df, ROLES), spearman_matrix(df, ROLES)):
        rows = {(r[0], r[1]): r[2] for r in found.collect()}
        assert len(rows) == 16
        assert rows["x", "k"] is None and rows["k", "k"] is None and rows["e", "x"] is None
        assert math.isclose(rows["x", "x"], 1.0)


def test_high_pairs_and_wide_matrix(table):
    features = ["y", "x", "twin"]
    part = table.select("id", *features)
    p, s = pearson_matrix(part, ROLES), spearman_matrix(part, ROLES)
    assert [(r.feat1, r.feat2) for r in high_pairs(p, s, features).collect()] == [("x", "twin")]
    wide = matrix_wide(p, features)
    assert wide.columns == ["feature", *features]
    assert wide.count() == 3


def test_scatter_points_are_capped_and_clean(table):
    points = scatter_pairs(table, ROLES, [("x", "twin"), ("y", "x")], ["id"], cap=100)
    rows = points.collect()
    assert len(rows) == 100 and {(r.feat1, r.feat2) for r in rows} == {("x", "twin")}
    again = scatter_pairs(table.repartition(3), ROLES, [("x", "twin")], ["id"], cap=100)
    assert {r.id for r in again.collect()} == {r.id for r in rows}


def test_median_imputation_interpolates(spark):
    df = spark.createDataFrame(
        [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, None), (6, float("nan"))], "id int, x double"
    )
    rows = median_impute(df, ["x"], ["id"]).orderBy("id").collect()
    assert [r.x for r in rows] == [1.0, 2.0, 3.0, 4.0, 2.5, 2.5]


def test_outliers_use_the_imputed_sample(spark):
    values = [0.0] * 500 + [None] * 300 + [1000.0]
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate(values)], "id int, y int, x double")
    row = outlier_counts(df, ["x"]).first()
    filled = pd.Series(values, dtype=float).fillna(0.0)
    assert math.isclose(row["mean"], filled.mean()) and math.isclose(row["std"], filled.std())
    assert row.n_outliers == 1


def test_missing_counts_null_and_nan(spark):
    df = spark.createDataFrame(
        [(None, 1, None), (float("nan"), 0, None), (2.0, None, None), (3.0, 1, None)],
        "x double, y int, e string",
    )
    rows = by_feature(missing_stats(df, ROLES))
    assert rows["x"].missing_rate == 0.5 and rows["x"].fraud_rate_missing == 0.5
    assert rows["x"].fraud_rate_present == 0.5
    assert rows["e"].missing_rate == 1.0 and rows["e"].fraud_rate_present is None


def test_describe_edges(spark):
    df = spark.createDataFrame(
        [(1.0, None, "a", 1), (float("nan"), None, None, 2), (3.0, None, "a", 3)],
        "x double, e double, s string, k short",
    )
    rows = by_feature(numeric_summary(df, ROLES))
    assert (rows["x"]["count"], rows["x"]["mean"], rows["x"]["max"]) == (2, 2.0, 3.0)
    assert rows["e"]["count"] == 0 and rows["e"].p50 is None
    assert rows["k"]["count"] == 3
    text = by_feature(categorical_describe(df, ROLES))["s"]
    assert (text["count"], text.null_count, text.distinct_count) == (2, 1, 1)


def test_approximate_percentiles_stay_within_the_rank_bound(table, sample):
    rows = by_feature(numeric_percentiles(table, ROLES, ["x"], method="approx"))
    values = np.sort(sample["x"])
    for name, p in (("p1", 0.01), ("p50", 0.5), ("p99", 0.99)):
        rank = np.searchsorted(values, rows["x"][name]) / len(values)
        assert abs(rank - p) <= 2 / 1000


def test_months_with_bad_dates(spark):
    df = spark.createDataFrame(
        [("2020-01-05", 1, 1), ("2020-01-31", 0, None), ("bad", 1, 0), (None, 0, 0)],
        "d string, b int, y int",
    )
    rows = monthly_stats(df, Roles(label="y", date="d", booked="b")).collect()
    assert [(str(r.month_start), r.total_apps, r.total_booked, r.total_fraud) for r in rows] == [
        ("None", 2, 1, 0),
        ("2020-01-01", 2, 1, 1),
    ]


def test_age_bins_are_right_closed(spark):
    ages = [0.0, 0.5, 0.51, 1.0, 2.0, 999.0, 1000.0, None]
    df = spark.createDataFrame([(a, 1) for a in ages], "max_open_age double, y int")
    rows = age_bin_rates(df, ROLES).collect()
    assert [(r.relat_age_bin, r["count"]) for r in rows] == [
        ("new_custs_<6mo", 1),
        ("newish_6mo_1y", 2),
        ("somewhat_new_1y_2y", 1),
        ("established_>2y", 1),
    ]
    assert age_bin_rates(df, ROLES, include_lowest=True).first()["count"] == 2


def test_bootstrap_interval_brackets_the_rate(spark):
    rows = [(0.3, int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "max_open_age double, y int")
    row = age_bin_bootstrap(df, ROLES).first()
    assert row.rate_low < row.fraud_rate < row.rate_high
    # the normal approximation of the same interval
    half = 1.96 * math.sqrt(0.25 * 0.75 / 400)
    assert abs(row.rate_high - row.rate_low - 2 * half) < 0.02
    assert age_bin_bootstrap(df.repartition(5), ROLES).first() == row


def test_lookback_columns_by_exact_name(spark):
    names = ["cc_apps_in_last_180_days", "total_apps_in_last_90", "total_apps_in_last_180_days"]
    df = spark.createDataFrame([(9, 0, 1), (9, 3, 29)], names)
    assert lookback_columns(df) == {
        90: "total_apps_in_last_90",
        180: "total_apps_in_last_180_days",
    }
    rows = by_feature(window_volume_stats(df), "window")
    assert rows["90_days"].zero_count == 1 and rows["180_days"].max_apps == 29


def test_histogram_edges(spark):
    values = [0.0, 1.0, 28.0, 29.0, 29.5, 30.0]
    df = spark.createDataFrame([(v,) for v in values], "total_apps_in_last_30_days double")
    rows = window_histogram(df).orderBy("bin").collect()
    assert [(r.bin, r["count"]) for r in rows] == [(1, 1), (28, 2)]


def test_top_categories_and_ties(spark):
    values = [f"v{i:02d}" for i in range(21)] * 2 + ["v20"]
    df = spark.createDataFrame([(v, 1) for v in values], "s string, y int")
    rows = category_rates(df, ROLES).collect()
    assert [r.value for r in rows] == ["v20"] + [f"v{i:02d}" for i in range(19)]
    assert {r.n_categories for r in rows} == {21}
    twenty = df.where("s <> 'v20'")
    assert category_rates(twenty, ROLES).count() == 20


def test_density_integrates_to_one(table):
    for bins in (30, "auto"):
        rows = density_histogram(table, ROLES, bins)
        area = rows.groupBy("feature", "label").agg(
            F.sum(F.col("density") * (F.col("bin_high") - F.col("bin_low"))).alias("a")
        )
        assert all(abs(r.a - 1) < 1e-9 for r in area.collect())


def test_density_of_one_value(spark):
    df = spark.createDataFrame([(5.0, 0), (5.0, 1)], "x double, y int")
    rows = density_histogram(df, ROLES, 10).collect()
    assert {(r.bin, r.bin_low, r.density) for r in rows} == {(5, 5.0, 10.0)}


def test_curve_is_close_to_the_exact_kernel_sum(table, sample):
    bounds = by_feature(clip_bounds(table, ROLES))["x"]
    clipped = sample[sample["x"].between(bounds.lower, bounds.upper)]
    for label in (0, 1):
        values = clipped.loc[clipped["y"] == label, "x"].to_numpy()
        h = values.std(ddof=1) * len(values) ** -0.2
        rows = kde_curve(table, ROLES).where((F.col("feature") == "x") & (F.col("label") == label))
        for r in rows.where("point % 40 = 7").collect():
            z = (r.x - values) / h
            exact = np.exp(-0.5 * z * z).sum() / (len(values) * h * math.sqrt(2 * math.pi))
            assert math.isclose(r.density, exact, rel_tol=1e-3)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, y int, x double, s string")
    assert missing_stats(df, ROLES).count() == 0
    assert numeric_describe(df, ROLES).count() == 0
    assert numeric_percentiles(df, ROLES).count() == 0
    assert information_values(df, ROLES).count() == 0
    assert pearson_matrix(df, ROLES).count() == 0
    assert category_rates(df, ROLES).count() == 0
    assert density_histogram(df, ROLES).count() == 0


def test_spearman_needs_no_key(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, 2000)
    pdf = pd.DataFrame({"id": np.arange(2000) % 100, "y": rng.integers(0, 2, 2000), "x": x})
    pdf["z"] = x + rng.normal(0, 0.2, 2000)
    found = spearman_matrix(frame(spark, pdf, "id bigint, y int, x double, z double"), ROLES)
    got = {(r.feat1, r.feat2): r.spearman for r in found.collect()}
    assert math.isclose(got["x", "z"], pdf["x"].rank().corr(pdf["z"].rank()), rel_tol=1e-9)


def test_spearman_with_deep_cuts(spark, monkeypatch):
    from labelscope.operators import correlation

    monkeypatch.setattr(correlation, "RANGE_ROWS", 2)
    monkeypatch.setattr(correlation, "MAX_TARGETS", 12**3)
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"id": range(3000), "y": 0, "a": rng.lognormal(0, 3, 3000)})
    pdf["b"] = np.where(rng.random(3000) < 0.5, 1.0, pdf["a"])
    pdf["c"] = rng.integers(0, 9, 3000) + pdf["a"].rank()
    found = spearman_matrix(frame(spark, pdf, "id int, y int, a double, b double, c double"), ROLES)
    for r in found.collect():
        expected = pdf[r.feat1].rank().corr(pdf[r.feat2].rank())
        if r.spearman is None:
            assert "y" in (r.feat1, r.feat2)
        else:
            assert math.isclose(r.spearman, expected, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("label", ["yes", "2", 2])
def test_labels_other_than_0_and_1_fail_loudly(spark, label):
    df = spark.createDataFrame([(1, label, 1.0)], f"id int, y {'string' if label != 2 else 'int'}, x double")
    with pytest.raises(Exception, match="label column y must be 0 or 1"):
        information_values(df, ROLES).collect()


def test_labels_as_text_and_numbers(spark):
    values = ["1.0", "0", None, "1", "NaN", " 0 "]
    df = spark.createDataFrame([(v,) for v in values], "y string")
    found = [r[0] for r in df.select(ROLES.target()).collect()]
    assert found == [1, 0, 0, 1, 0, 0]


@pytest.mark.parametrize("schema", ["id int, y int, s string", "id int, y int, x double", "id int, y int"])
def test_tables_without_a_class_of_features(spark, tmp_path, schema):
    from labelscope.plans.suite import full_report

    width = schema.count(",") + 1
    rows = [(i, i % 2, *[str(i % 3) if "string" in schema else float(i)] * (width - 2)) for i in range(40)]
    df = spark.createDataFrame(rows, schema)
    full_report(df, ROLES, str(tmp_path), ["id"], seeds=1, trees=2, depth=2)
    empty = df.where(F.lit(False))
    assert information_values(empty, ROLES).collect() is not None
    assert missing_stats(empty, ROLES).collect() is not None


def test_scatter_without_pairs_is_empty(table):
    found = scatter_pairs(table, ROLES, [("y", "x")], ["id"])
    assert found.columns == ["feat1", "feat2", "id", "x", "y", "y"] or found.count() == 0
