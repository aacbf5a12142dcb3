"""Helpers of the registered queries and of their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.arrays import cells
from lexiloom.operators.kernels import StructuredModel
from lexiloom.session import spread

# Constants of the published 32-bit MurmurHash3, in decimal for SQL.
C1, C2, ADD, F1, F2 = 3432918353, 461845907, 3864292196, 2246822507, 3266489909
MASK = 4294967295


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows carry much work each."""
    return spread(table(spark, sf_dir, name))


def rounded(col: Column | str, places: int = 6) -> Column:
    """Double at fixed precision without negative zero."""
    x = F.col(col) if isinstance(col, str) else col
    return F.round(x.cast("double"), places) + F.lit(0.0)


def long_codes(encoded: DataFrame, places: int = 6) -> DataFrame:
    """(key, features) to (key, component, value)."""
    return cells(encoded, ["key"], "features").withColumn("value", rounded("value", places))


def codes_of(model, df: DataFrame, column: str, places: int = 6) -> DataFrame:
    """A fitted model's codes of each distinct string."""
    keys = df.select(F.col(column).alias("key")).distinct()
    if isinstance(model, StructuredModel):
        return model.encode_long(keys).withColumn("value", rounded("value", places))
    return long_codes(model.encode(keys), places)


def grams_sql(source: str, lo: int = 2, hi: int = 4) -> str:
    """(key, term) rows of the n-grams of ``source.key``."""
    return rf"""
        SELECT key, substr(s, i::BIGINT, n::BIGINT) AS term
        FROM (SELECT key, regexp_replace(lower(key), '\s\s+', ' ', 'g') AS s FROM {source}),
             unnest(range({lo}, {hi + 1})) AS a(n), unnest(range(1, length(s) - n + 2)) AS b(i)"""


def padded_grams_sql(source: str, lo: int = 2, hi: int = 4) -> str:
    """(key, term) rows of the distinct n-grams of the padded string."""
    return rf"""
        SELECT DISTINCT key, substr(s, i::BIGINT, n::BIGINT) AS term
        FROM (SELECT key, ' ' || trim(regexp_replace(lower(key), '\s+', ' ', 'g')) || ' ' AS s FROM {source}),
             unnest(range({lo}, {hi + 1})) AS a(n), unnest(range(1, length(s) - n + 2)) AS b(i)"""


def murmur_sql(grams: str, seeds: str) -> str:
    """CTEs ending in ``hashed(term, seed, h)`` for ASCII terms of two to four bytes."""
    rotl = lambda x, r: f"((({x}) << {r}) & {MASK}) | (({x}) >> {32 - r})"
    byte = lambda i: f"(CASE WHEN length(term) > {i} THEN ascii(substr(term, {i + 1}, 1)) ELSE 0 END)::UBIGINT << {8 * i}"
    return f"""
        packed AS (SELECT term, length(term)::UBIGINT AS len, ({byte(0)}) | ({byte(1)}) | ({byte(2)}) | ({byte(3)}) AS w
                   FROM (SELECT DISTINCT term FROM {grams})),
        mixed1 AS (SELECT term, len, (w * {C1}::UBIGINT) & {MASK} AS w FROM packed),
        mixed2 AS (SELECT term, len, (({rotl('w', 15)}) * {C2}::UBIGINT) & {MASK} AS w FROM mixed1),
        seeded AS (SELECT term, len, seed, xor(w, seed::UBIGINT) AS h FROM mixed2, {seeds}),
        bodied AS (SELECT term, len, seed, CASE WHEN len = 4
                   THEN ((({rotl('h', 13)}) * 5::UBIGINT) + {ADD}::UBIGINT) & {MASK} ELSE h END AS h FROM seeded),
        final1 AS (SELECT term, seed, xor(h, len) AS h FROM bodied),
        final2 AS (SELECT term, seed, (xor(h, h >> 16) * {F1}::UBIGINT) & {MASK} AS h FROM final1),
        final3 AS (SELECT term, seed, (xor(h, h >> 13) * {F2}::UBIGINT) & {MASK} AS h FROM final2),
        hashed AS (SELECT term, seed, xor(h, h >> 16) AS h FROM final3)"""
