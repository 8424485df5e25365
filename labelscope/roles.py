"""Which column plays which part in a labelled table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelscope.functions.columns import quoted


@dataclass(frozen=True)
class Roles:
    """Column roles of one labelled table.

    ``ignore`` lists keys and other columns that are never features. The
    label, date and booked columns are left out of the features too, unless an
    operator asks for them.
    """

    label: str = "label"
    date: str | None = None
    booked: str | None = None
    ignore: tuple[str, ...] = ()
    label_fill: int | None = 0

    def with_ignored(self, *names: str) -> Roles:
        return replace(self, ignore=tuple(dict.fromkeys(self.ignore + names)))

    def features(self, df: DataFrame, keep: tuple[str, ...] = ()) -> list[str]:
        """Feature names in table order; ``keep`` lets role columns back in."""
        dropped = {self.label, self.date, self.booked, *self.ignore} - set(keep)
        return [name for name in df.columns if name not in dropped]

    def numeric(self, df: DataFrame, keep: tuple[str, ...] = ()) -> list[str]:
        """Features of any integer, floating or decimal type."""
        return [c for c in self.features(df, keep) if is_numeric(df, c)]

    def categorical(self, df: DataFrame, keep: tuple[str, ...] = ()) -> list[str]:
        """Every other feature: strings, dates, timestamps, booleans."""
        return [c for c in self.features(df, keep) if not is_numeric(df, c)]

    def target(self) -> Column:
        """The label as an int, with nulls (and NaN) filled by ``label_fill``.

        Text is read as a number, so "1.0" is 1. The query fails on any other
        value than 0 and 1, and names the column and the value.
        """
        label = F.col(quoted(self.label))
        number = label.try_cast("double")
        message = F.concat(
            F.lit(f"label column {self.label} must be 0 or 1, found "), label.cast("string")
        )
        y = (
            F.when(label.isNull() | F.isnan(number), F.lit(None).cast("int"))
            .when(number.isin(0.0, 1.0), number.cast("int"))
            .otherwise(F.raise_error(message).cast("int"))
        )
        return y if self.label_fill is None else F.coalesce(y, F.lit(self.label_fill))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)
