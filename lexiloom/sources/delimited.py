"""Delimited text of every layout the datasets come in."""

from __future__ import annotations

import csv
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_csv(spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8",
             header: bool = True, schema: StructType | str | None = None,
             names: Sequence[str] | None = None, index_name: str | None = None,
             multiline: bool = False) -> DataFrame:
    """Delimited scan.

    Give ``schema`` for production tables: without it one extra pass infers types.
    ``names`` renames a headerless file's columns (positions as text when absent);
    ``index_name`` names the leading column where it is the row's id and not a feature, with or without a header of its own. Only a file with
    quoted line breaks needs ``multiline``, which reads it in one task.
    """
    reader = spark.read.option("sep", sep).option("encoding", encoding).option("header", header)
    reader = reader.option("quote", '"').option("escape", '"').option("multiLine", multiline)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    if names is not None:
        df = df.toDF(*names)
    elif not header:
        df = df.toDF(*[str(i) for i in range(len(df.columns))])
    if index_name is not None:
        df = df.withColumnRenamed(df.columns[0], index_name)
    return df


def scan_csv_skip(spark: SparkSession, path: str, skip: int, schema: StructType | str | None = None,
                  sep: str = ",") -> DataFrame:
    """Delimited files whose header follows ``skip`` lines.

    Lines are dropped by their place in the first block of each file, in one pass and
    for any number of files; the JVM then parses the rest. All files share a header.
    """
    lines = spark.read.text(path)
    if schema is None:
        header = lines.limit(skip + 1).collect()[skip]["value"]
        names = next(csv.reader([header], delimiter=sep))
        schema = ", ".join(f"`{n}` string" for n in names)

    def body(batches):
        place, seen = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            file = batch.column("file").dictionary_encode()
            codes, start = file.indices.to_numpy(), batch.column("start").to_numpy()
            edge = np.flatnonzero((np.diff(codes) != 0) | (np.diff(start) != 0)) + 1
            line = np.arange(n)
            bounds = [0, *edge.tolist(), n]
            for low, high in zip(bounds[:-1], bounds[1:]):
                here = (file.dictionary[codes[low]].as_py(), start[low])
                seen = seen if here == place else 0
                line[low:high] += seen - low
                place, seen = here, seen + high - low
            yield batch.select(["value"]).filter(pa.array((start > 0) | (line > skip)))

    placed = lines.select("value", F.col("_metadata.file_path").alias("file"),
                          F.col("_metadata.file_block_start").alias("start"))
    shape = schema if isinstance(schema, str) else schema.simpleString()[len("struct<"):-1]
    parsed = F.from_csv("value", shape, {"sep": sep, "escape": '"'})
    return placed.mapInArrow(body, "value string").select(parsed.alias("row")).select("row.*")


def scan_tagged_files(spark: SparkSession, paths: list[str], columns: list[str],
                      tags: dict[str, str], tag_column: str = "status", **options) -> DataFrame:
    """Project the columns of many files, tag rows by a mark in the file path, dedupe."""
    scanned = scan_csv(spark, paths, **options)
    name = F.col("_metadata.file_path")
    tag = F.lit(None).cast("string")
    for mark, value in reversed(tags.items()):
        tag = F.when(name.contains(mark), value).otherwise(tag)
    return scanned.select(*columns, tag.alias(tag_column)).filter(F.col(tag_column).isNotNull()).dropDuplicates()
