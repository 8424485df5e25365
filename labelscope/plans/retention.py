"""Features worth keeping although most of their values are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The smallest missing rate and Information Value reported.
MIN_MISSING = 0.45
MIN_IV = 0.05


def retention_report(
    missing: DataFrame,
    iv: DataFrame,
    min_missing: float = MIN_MISSING,
    min_iv: float = MIN_IV,
) -> DataFrame:
    """``(feature, missing_rate, iv)`` of often-missing, still predictive features."""
    return (
        missing.join(iv, "feature")
        .where((F.col("missing_rate") >= min_missing) & (F.col("iv") >= min_iv))
        .select("feature", "missing_rate", "iv")
        .orderBy(F.desc("iv"), "feature")
    )
