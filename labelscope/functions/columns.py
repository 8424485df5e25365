"""Cleaning, ratios and portable hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A column name inside a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def double_sql(df: DataFrame, name: str) -> str:
    """A numeric column as double; NaN becomes null so it counts as missing.

    Expressions over hundreds of columns are put together as text, which
    Spark parses in one go.
    """
    number = f"cast({quoted(name)} as double)"
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return f"nanvl({number}, cast(null as double))"
    return number


def as_double(df: DataFrame, name: str) -> Column:
    """:func:`double_sql` as a column."""
    return F.expr(double_sql(df, name))


def text_sql(name: str) -> str:
    return f"cast({quoted(name)} as string)"


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division as double; null when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def parse_date(df: DataFrame, name: str) -> Column:
    """A date column; malformed strings become null instead of failing the job."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.try_to_date(F.col(name))
    return F.col(name).cast("date")


def uniform_hash(keys: Sequence[str], seed: int, portable: bool = False) -> Column:
    """A value in [0, 1) that depends only on the keys and the seed.

    The same rows are chosen under any partitioning and on any retry. Pass
    ``portable=True`` for a value that any engine with MD5 can compute too, at
    several times the cost: the first 52 bits of the digest of the keys as text
    and the seed, joined by ``|``. In a key, backslash and ``|`` are escaped by
    a backslash, and null is ``\\N``, so different keys have different texts.
    """
    if not portable:
        return F.xxhash64(*[F.col(quoted(k)) for k in keys], F.lit(seed)) / F.lit(2.0**64) + 0.5
    parts = [
        F.coalesce(
            F.replace(
                F.replace(F.col(quoted(k)).cast("string"), F.lit("\\"), F.lit("\\\\")),
                F.lit("|"),
                F.lit("\\|"),
            ),
            F.lit("\\N"),
        )
        for k in keys
    ]
    text = F.concat_ws("|", *parts, F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
