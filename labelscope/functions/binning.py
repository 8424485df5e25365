"""Bin indexes as plain comparisons and arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval_label(
    x: Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False
) -> Column:
    """Label of the right-closed interval (edge, next edge] holding x, or null."""
    above_first = x >= edges[0] if include_lowest else x > edges[0]
    branches = F.when(x.isNull() | ~above_first, F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels, strict=True):
        branches = branches.when(x <= upper, label)
    return branches


def edge_index(x: str, inner_edges: Sequence[str], closed: str = "right") -> Column:
    """Index of the bin holding column x, given the columns of the inner edges.

    Right-closed bins count the edges below x, left-closed bins those at or
    below it. Null edges count as absent.
    """
    compare = {"right": ">", "left": ">="}[closed]
    return F.expr(" + ".join(["0", *[f"if({x} {compare} {e}, 1, 0)" for e in inner_edges]]))


def width_index(x: Column, low: Column, high: Column, bins: int | Column) -> Column:
    """Index of the equal-width bin [a, b) holding x; the last bin is closed."""
    bins = F.lit(bins) if isinstance(bins, int) else bins
    step = (high - low) / bins
    return F.least(F.floor((x - low) / step), (bins - 1).cast("bigint"))


def unit_bin(x: Column, last: int) -> Column:
    """Unit-width integer bin of x; the bin starting at ``last`` is closed on the right."""
    return F.least(F.floor(x), F.lit(last).cast("bigint"))


def magnitude_cell(x: Column, per_efold: int) -> Column:
    """Cell of x on a signed logarithmic grid with ``per_efold`` cells per factor e.

    The mapping never decreases as x grows, so cells order the same way as
    values, for any double and without knowing the range first. 750 exceeds
    the logarithm of the smallest positive double, which keeps both halves of
    the grid on their own side of zero.
    """
    # infinity goes to the last cell
    up = F.floor(F.least((F.ln(x) + 750) * per_efold, F.lit(2.0**31 - 1))).cast("int")
    down = -F.floor(F.least((F.ln(-x) + 750) * per_efold, F.lit(2.0**31 - 1))).cast("int")
    return F.when(x > 0, up).when(x < 0, down).otherwise(F.lit(0))
