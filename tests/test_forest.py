import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelscope.operators import forest, importance
from labelscope.operators.forest import (
    Level,
    best_splits,
    bin_edges,
    class_weights,
    enter_splits,
    fewer_points,
    forest_importances,
    held,
    merged_points,
    points_edges,
    tree_importances,
)
from labelscope.operators.importance import model_table, rf_importance, rf_importance_by_seed
from labelscope.roles import Roles
from labelscope.sources.scratch import materialize

ROLES = Roles(label="y", ignore=("id",))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 3000
    y = (rng.random(n) < 0.25).astype(int)
    pdf = pd.DataFrame(
        {
            "id": range(n),
            "y": y,
            "strong": rng.normal(0, 1, n) + 1.5 * y,
            "fair": rng.normal(0, 1, n) + 0.5 * y,
            "weak": rng.normal(0, 1, n),
            "few": rng.integers(0, 4, n),
            "kind": rng.choice(["a", "b", "c"], n),
        }
    )
    pdf.loc[::7, "fair"] = None
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def model(table):
    """The model table in one file, with inputs x0, x1, …"""
    prepared, features = model_table(table, ROLES)
    inputs = [f"x{i}" for i in range(len(features))]
    renamed = prepared.toDF("_label", "_weight", *inputs)
    return materialize(renamed.coalesce(1), "forest-test"), inputs


def gini(counts):
    whole = sum(counts)
    return 1 - sum((c / whole) ** 2 for c in counts) if whole else 0.0


def plain_importances(rows, y, times, edges, weights, key, depth):
    """One tree, grown from lists of rows."""
    n = len(edges)
    few = math.ceil(math.sqrt(n))

    def counts(inside):
        return [sum(times[i] for i in inside if y[i] == c) for c in (0, 1)]

    def weighted(inside):
        return [c * w for c, w in zip(counts(inside), weights, strict=True)]

    root = {"rows": range(len(rows)), "sides": None}
    nodes = [root]
    for level in range(depth):
        tried = forest._tried(key, level, len(nodes), n, few)
        after = []
        for node, features in zip(nodes, tried, strict=True):
            best = 0.0
            own = weighted(node["rows"])
            for f in features:
                for edge in edges[f]:
                    sides = [
                        [i for i in node["rows"] if rows[i][f] <= edge],
                        [i for i in node["rows"] if rows[i][f] > edge],
                    ]
                    if not all(sum(counts(s)) for s in sides):
                        continue
                    parts = [weighted(s) for s in sides]
                    gain = gini(own) - sum(sum(p) / sum(own) * gini(p) for p in parts)
                    if gain > best:
                        best = gain
                        node |= {"feature": f, "gain": gain}
                        node["sides"] = [{"rows": s, "sides": None} for s in sides]
            for side in node["sides"] or []:
                if all(counts(side["rows"])):
                    after.append(side)
        nodes = after
        if not nodes:
            break
    total = np.zeros(n)

    def said(node):
        """What a leaf predicts, or None for a split that is kept."""
        own = weighted(node["rows"])
        if node["sides"] is None:
            return int(own[1] > own[0])
        both = [said(s) for s in node["sides"]]
        if both[0] is not None and both[0] == both[1]:
            return both[0]
        total[node["feature"]] += node["gain"] * sum(own)
        return None

    said(root)
    return total / total.sum() if total.sum() else total


def test_trees_are_those_of_a_plain_search_over_rows(model, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 1100)
    monkeypatch.setattr(forest, "TREES_AT_ONCE", 2)
    rows_table, inputs = model
    weights = class_weights(rows_table)
    edges = bin_edges(rows_table, inputs, weights)
    found = forest_importances(rows_table, inputs, [3, 5], 2, 3)
    cells = rows_table.toPandas()
    rows, y = cells[inputs].to_numpy(), cells["_label"].to_numpy()
    for seed, own in zip([3, 5], found, strict=True):
        trees = []
        for tree in range(2):
            times = np.zeros(len(rows))
            for at in range(3):
                here, k = held(seed, tree, 0, at, min(1100, len(rows) - 1100 * at))
                times[1100 * at + here] = k
            trees.append(plain_importances(rows, y, times, edges, weights, (seed, tree), 3))
        assert np.allclose(own, np.sum(trees, axis=0) / 2, rtol=1e-9)


def test_large_tables_are_fitted_without_spark_ml(table, monkeypatch):
    """At 400 ns for a row, tree and level Spark ML takes hours over tens of millions of rows."""

    def never(**_):
        raise AssertionError("fitted by Spark ML")

    monkeypatch.setattr(importance, "ML_ROWS", 2999)
    monkeypatch.setattr(importance, "RandomForestClassifier", never)
    found = rf_importance_by_seed(table, ROLES)
    sums = {r.seed: r.s for r in found.groupBy("seed").agg(F.sum("importance").alias("s")).collect()}
    assert sorted(sums) == [0, 1, 2, 3, 4]
    assert all(math.isclose(s, 1.0, rel_tol=1e-9) for s in sums.values())
    assert found.count() == 25
    assert rf_importance(found).first().feature == "strong"
    assert len({r.importance for r in found.where("feature = 'strong'").collect()}) == 5


def test_forests_agree_with_those_of_spark_ml(table, monkeypatch):
    settings = {"seeds": 3, "trees": 20, "depth": 4}
    theirs = {r.feature: r for r in rf_importance(rf_importance_by_seed(table, ROLES, **settings)).collect()}
    monkeypatch.setattr(importance, "ML_ROWS", 0)
    ours = {r.feature: r for r in rf_importance(rf_importance_by_seed(table, ROLES, **settings)).collect()}
    assert set(ours) == set(theirs)
    for name, own in ours.items():
        assert abs(own.rf_importance_mean - theirs[name].rf_importance_mean) < 0.06


def test_counts_given_away_early_and_in_any_split_of_the_work_are_the_same(model, monkeypatch):
    rows_table, inputs = model
    monkeypatch.setattr(forest, "BLOCK", 500)
    whole = forest_importances(rows_table, inputs, [0], 6, 5)
    monkeypatch.setattr(forest, "COUNTED_ROWS", 900)
    monkeypatch.setattr(forest, "COUNT_BYTES", 1)
    monkeypatch.setattr(forest, "MERGES", 2)
    assert forest_importances(rows_table, inputs, [0], 6, 5) == whole


def test_bins_of_few_and_of_many_values(spark, monkeypatch):
    n = 20_000
    df = spark.range(n).select(
        (F.col("id") % 5 == 0).cast("double").alias("_label"),
        F.when(F.col("id") % 5 == 0, 2.5).otherwise(0.625).alias("_weight"),
        (F.col("id") % 31).cast("double").alias("x0"),
        (F.col("id") * 7919 % n).cast("double").alias("x1"),
        F.lit(3.0).alias("x2"),
        F.when(F.col("id") % 10 == 0, F.col("id") * 1.0).otherwise(-1.0).alias("x3"),
    )
    df = materialize(df.repartition(6), "bins")
    inputs = ["x0", "x1", "x2", "x3"]
    monkeypatch.setattr(forest, "POINTS", 2000)
    monkeypatch.setattr(forest, "SORTED_ROWS", 700)
    edges = bin_edges(df, inputs, class_weights(df))
    assert edges[0].tolist() == list(range(30))
    assert len(edges[1]) == 31
    assert np.abs(edges[1] - (np.arange(1, 32) / 32 * n)).max() < n / 32 / 10
    assert edges[2].tolist() == []
    # half of class 1 and all of class 0, three quarters of the weight, have one value; the
    # rest is still parted into bins of a 32nd
    assert edges[3][0] == -1.0
    assert np.abs(edges[3][-7:] - np.arange(1, 8) / 8 * n).max() < n / 8 / 10


def test_edges_of_weighted_points_follow_spark_ml():
    points = np.array([[float(i), 1.0, 0.0] for i in range(100)])
    edges = points_edges(points, np.array([1.0, 5.0]), bins=4)
    assert edges.tolist() == [24.0, 49.0, 74.0]
    points[90:, 1:] = [0.0, 10.0]
    heavier = points_edges(points, np.array([1.0, 5.0]), bins=4)
    assert heavier.tolist() == [90.0, 93.0, 96.0]


def test_fewer_points_keep_the_ranks():
    rng = np.random.default_rng(0)
    values = np.unique(rng.normal(size=5000))
    points = np.column_stack([values, np.ones(len(values)), np.zeros(len(values))])
    few = fewer_points(points, 200, np.array([1.0, 1.0]))
    assert len(few) <= 200
    assert few[:, 1].sum() == len(values) and few[-1, 0] == values[-1]
    at = np.searchsorted(values, few[:, 0], side="right")
    assert (np.cumsum(few[:, 1]) == at).all()
    both = merged_points([points[:3], points[1:4]])
    assert both[:, 0].tolist() == values[:4].tolist() and both[:, 1].tolist() == [1, 2, 2, 1]


def test_rows_are_held_as_often_as_poisson_says():
    times = np.zeros(200_000)
    rows, k = held(1, 2, 3, 4, len(times))
    times[rows] = k
    for count in range(5):
        expected = math.exp(-1) / math.factorial(count)
        assert abs((times == count).mean() - expected) < 0.005
    assert (held(1, 2, 3, 4, 999)[0] == held(1, 2, 3, 4, 999)[0]).all()
    assert len(held(1, 2, 3, 5, 999)[0]) and list(held(1, 2, 3, 5, 999)[0]) != list(held(1, 2, 3, 4, 999)[0])


def test_splits_without_effect_are_taken_back():
    """A split whose leaves predict the same has no importance, nor has one above it then."""
    weights = np.array([1.0, 1.0])
    root = Level(np.array([[0, 1]]))
    # k, bin, gain, size by class, left by class
    assert enter_splits(root, np.array([[0, 3, 0.1, 70, 30, 60, 5]]), True) == 2
    both = Level(np.array([[1, 2], [0, 1]]))
    assert enter_splits(both, np.array([[0, 1, 0.2, 60, 5, 50, 1], [0, 1, 0.0, 10, 25, 0, 0]]), False) == 0
    kept = tree_importances([root, both], 3, weights)
    # the left node's leaves both predict 0; the right one predicts 1
    assert kept.tolist() == [1.0, 0.0, 0.0]
    none = Level(np.array([[0, 1]]))
    assert enter_splits(none, np.array([[0, 3, 0.1, 70, 30, 40, 5]]), False) == 0
    assert tree_importances([none], 3, weights).tolist() == [0.0, 0.0, 0.0]


def test_a_split_leaves_rows_on_both_sides():
    counts = np.zeros((1, 1, forest.BINS, 2))
    counts[0, 0, 4] = [10, 10]
    found = best_splits(counts, np.array([[0]]), np.array([31]), np.array([1.0, 1.0]))
    assert found[0, 2] == 0
    counts[0, 0, 9] = [0, 5]
    k, b, gain, *_ = best_splits(counts, np.array([[0]]), np.array([31]), np.array([1.0, 1.0]))[0]
    assert (k, b) == (0, 4) and gain > 0
    # the bins end before it
    assert best_splits(counts, np.array([[0]]), np.array([4]), np.array([1.0, 1.0]))[0, 2] == 0


@pytest.mark.parametrize("value", [None, float("nan")])
def test_values_that_are_missing_are_refused(spark, value):
    df = spark.createDataFrame([(0.0, 1.0, 2.0), (1.0, 1.0, value)], "_label double, _weight double, x0 double")
    with pytest.raises(Exception, match="null or NaN among the values"):
        forest_importances(materialize(df, "missing"), ["x0"], [0], 2, 2)


def test_labels_are_checked_and_one_class_has_no_importance(spark):
    schema = "_label double, _weight double, x0 double, x1 double"
    one = spark.createDataFrame([(0.0, 0.5, float(i), 1.0) for i in range(9)], schema)
    assert forest_importances(materialize(one, "one"), ["x0", "x1"], [0, 1], 2, 2) == [[0.0, 0.0]] * 2
    other = spark.createDataFrame([(None, 0.5, 1.0, 1.0)], schema)
    with pytest.raises(ValueError, match="labels must be 0 or 1"):
        forest_importances(materialize(other, "other"), ["x0", "x1"], [0], 2, 2)


def test_few_large_rows_are_held_at_once(spark):
    rows, read = forest._BATCHES
    before = {s: spark.conf.get(s) for s in forest._BATCHES}
    spark.conf.set(rows, 16)
    try:
        with pytest.raises(RuntimeError), forest.few_rows_at_once(spark):
            # a smaller one is left as it is
            assert (spark.conf.get(rows), spark.conf.get(read)) == ("16", "64")
            raise RuntimeError
        assert (spark.conf.get(rows), spark.conf.get(read)) == ("16", before[read])
    finally:
        spark.conf.set(rows, before[rows])
