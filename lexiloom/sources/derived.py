"""Derived tables that are built once and read back afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path holds readable data, as the reader itself sees it."""
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as failure:
        if "PATH_NOT_FOUND" in str(failure) or "UNABLE_TO_INFER_SCHEMA" in str(failure):
            return False
        raise


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a table this library wrote, through the file system its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the derived table, building and writing it first when it is missing."""
    if not table_exists(spark, path):
        build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
