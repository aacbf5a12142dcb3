"""Append-only results: one row per fold, keyed by the run's configuration."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources.derived import table_exists

SCHEMA = ("config_key string, config string, fold bigint, n_train_samples bigint, n_train_features bigint, "
          "score double, encoding_time double, training_time double")


def config_text(config: dict) -> str:
    return json.dumps(config, sort_keys=True, default=str)


def config_key(*parts: Column) -> Column:
    """Digest of a configuration held in columns."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def append_results(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    results.write.mode("append").format(fmt).save(path)


def record_run(spark: SparkSession, path: str, config: dict, folds: list[tuple], fmt: str = "parquet") -> None:
    """One record per fold: (fold, rows, features, score, encoding s, training s)."""
    text = config_text(config)
    rows = [(text, int(f), int(n), int(w), float(s), float(e), float(t)) for f, n, w, s, e, t in folds]
    named = spark.createDataFrame(rows, "config string, fold bigint, n_train_samples bigint, n_train_features "
                                        "bigint, score double, encoding_time double, training_time double")
    append_results(named.select(F.sha2("config", 256).alias("config_key"), "*"), path, fmt)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    if table_exists(spark, path):
        return spark.read.schema(SCHEMA).parquet(path)
    return spark.createDataFrame([], SCHEMA)


def pending(planned: DataFrame, done: DataFrame, key: str = "config_key") -> DataFrame:
    """Planned runs without a stored record of an equal configuration."""
    return planned.join(done.select(key).distinct(), key, "left_anti")
