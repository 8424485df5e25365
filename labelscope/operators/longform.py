"""From columns to rows: the layout every per-feature operator shares.

A wide row becomes one ``(fid, value)`` row per feature, where ``fid`` is the
position of the feature in the list. Aggregating that relation by ``fid``
collapses it inside each task, so what is shuffled is one small row per task
and feature, however many rows the table holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.functions.columns import double_sql, quoted, text_sql

# Spark stops generating code for operators with over 100 fields, so wide
# tables are taken in slices; each slice scans only its own columns.
SLICE = 80


def _explode(
    df: DataFrame,
    features: Sequence[str],
    keep: Sequence[Column],
    cell: Callable[[str], str],
    name: str,
) -> DataFrame:
    if not features:
        kind = {"value": "string" if cell is text_sql else "double", "missing": "boolean"}[name]
        none = [F.lit(0).alias("fid"), F.lit(None).cast(kind).alias(name)]
        return df.select(*keep, *none).where(F.lit(False))
    parts = []
    for start in range(0, len(features), SLICE):
        cells = ", ".join(cell(c) for c in features[start : start + SLICE])
        part = df.select(*keep, F.expr(f"posexplode(array({cells})) AS (fid, {name})"))
        if start:
            part = part.withColumn("fid", F.col("fid") + start)
        parts.append(part)
    return reduce(DataFrame.unionAll, parts)


def numeric_long(df: DataFrame, features: Sequence[str], *keep: Column) -> DataFrame:
    """``(keep…, fid, value)`` with values as double, null where missing or NaN."""
    return _explode(df, features, keep, lambda c: double_sql(df, c), "value")


def text_long(df: DataFrame, features: Sequence[str], *keep: Column) -> DataFrame:
    """``(keep…, fid, value)`` with values as text."""
    return _explode(df, features, keep, text_sql, "value")


def missing_long(
    df: DataFrame, features: Sequence[str], numeric: Sequence[str], *keep: Column
) -> DataFrame:
    """``(keep…, fid, missing)``: whether each feature is null (or NaN) in a row."""
    numbers = set(numeric)

    def cell(name: str) -> str:
        return f"{double_sql(df, name) if name in numbers else quoted(name)} IS NULL"

    return _explode(df, features, keep, cell, "missing")


def feature_name(features: Sequence[str], fid: str = "fid") -> Column:
    """The name behind a feature position."""
    return F.get(F.array(*[F.lit(f) for f in features]).cast("array<string>"), F.col(fid))


def with_per_feature(
    df: DataFrame, name: str, relation: DataFrame, features: Sequence[str], *columns: str
) -> DataFrame:
    """The table with a struct ``name`` holding a ``(fid, column…)`` relation.

    Field ``column_i`` belongs to feature i. The struct is a scalar subquery:
    it runs once, and a task receives one value per feature and column.
    """
    if not features:
        return df.withColumn(name, F.lit(None).cast("struct<none: int>"))
    cells = [
        f"max(if(fid = {i}, {c}, null)) AS {c}_{i}" for c in columns for i in range(len(features))
    ]
    return df.withColumn(name, relation.selectExpr(f"struct({', '.join(cells)}) AS s").scalar())
