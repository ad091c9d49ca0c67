"""Rounding as the metric catalogue defines it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_places(x: Column, places: int) -> Column:
    """Half away from zero on the scaled value: 1.005 to two places is 1.0, as the binary number is less than 1.005."""
    scale = F.lit(float(10**places))
    return F.round(x.cast("double") * scale) / scale


def significant(x: Column, digits: int = 6) -> Column:
    x = x.cast("double")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1.0) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def ratio(part: Column, whole: Column, places: int | None = None) -> Column:
    """Null over an empty population, never zero; ``places`` for fixed decimals instead of six significant digits."""
    x = part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")
    return significant(x) if places is None else round_places(x, places)
