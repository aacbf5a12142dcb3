"""Numeric expressions that stay defined where ANSI mode or ``ln`` would not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ln(col: Column, shift: float = 0.0) -> Column:
    """Natural log of ``col + shift``; -inf at zero and NaN below it."""
    x = col.cast("double") + F.lit(float(shift))
    return (
        F.when(x > 0, F.ln(x))
        .when(x == 0, F.lit(float("-inf")))
        .when(x < 0, F.lit(float("nan")))
    )


def parse_percent(col: Column) -> Column:
    """``63%`` as 63.0; null when the rest is not a number."""
    text = col.cast("string")
    return F.substr(text, F.lit(1), F.length(text) - 1).try_cast("double")


def parse_thousands(col: Column) -> Column:
    """``1,234.5`` as 1234.5; null when it is not a number."""
    return F.regexp_replace(col.cast("string"), ",", "").try_cast("double")


def finite(col: Column) -> Column:
    x = col.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
