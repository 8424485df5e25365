"""Column expressions: everything here stays inside generated JVM code."""

from labelscope.functions.binning import (
    edge_index,
    interval_label,
    magnitude_cell,
    unit_bin,
    width_index,
)
from labelscope.functions.columns import (
    as_double,
    double_sql,
    parse_date,
    quoted,
    ratio,
    text_sql,
    uniform_hash,
)

__all__ = [
    "as_double",
    "double_sql",
    "edge_index",
    "interval_label",
    "magnitude_cell",
    "parse_date",
    "quoted",
    "ratio",
    "text_sql",
    "uniform_hash",
    "unit_bin",
    "width_index",
]
