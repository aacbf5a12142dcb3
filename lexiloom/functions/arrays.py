"""Lists of computed values as rows.

The plain ``explode`` makes the optimizer infer a filter on the list's size and push it
towards the scan, where the list (n-grams of a text, a Python code) is computed a second
time, possibly before the shuffle that would have spread the work. The outer form infers
nothing; empty lists are dropped afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, keep: list, items: Column, name: str) -> DataFrame:
    """Kept columns and one row per item."""
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def cells(df: DataFrame, keep: list, code: Column | str, position: str = "component", value: str = "value") -> DataFrame:
    """Kept columns and one (position, value) row per entry of a dense code."""
    out = df.select(*keep, F.posexplode_outer(code).alias(position, value)).filter(F.col(position).isNotNull())
    return out.withColumn(position, F.col(position).cast("bigint"))


def sparse_cells(df: DataFrame, keep: list, vector: str = "features") -> DataFrame:
    """The same for a struct of indices and values."""
    pairs = exploded(df, keep, F.arrays_zip(f"{vector}.indices", f"{vector}.values"), "_c")
    return pairs.select(*keep, F.col("_c.indices").cast("bigint").alias("component"), F.col("_c.values").alias("value"))
