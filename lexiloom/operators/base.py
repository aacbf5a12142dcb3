"""Protocol shared by all encoders.

An encoder is an ``Estimator``; its model keeps DataFrames (``tables``) and a small
dictionary (``meta``). Models encode *distinct* strings and join the result back, so
the cost follows the number of different strings, not the number of rows.
"""

from __future__ import annotations

import importlib
import json
import warnings

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
    MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.arrays import cells, sparse_cells
from lexiloom.operators.prep import stringify
from lexiloom.session import checkpointed, split_join

# Widest dense code built by pivoting.
PIVOT_WIDTH = 10_000


def param(name: str, doc: str, converter=None) -> Param:
    return Param(Params._dummy(), name, doc, converter or TypeConverters.identity)


def dense(long: DataFrame, width: int, value: Column, group: tuple[str, ...] = ("key",)) -> DataFrame:
    """(group, features): sums of ``value`` by component as one array.

    Rows whose component is null only keep their group alive. ``pivot`` with explicit
    values aggregates into one buffer per group and needs no extra shuffle when the
    input is already partitioned by it.
    """
    if width > PIVOT_WIDTH:
        raise ValueError(f"a dense code of width {width} is not supported, use a reduction")
    wide = long.groupBy(*group).pivot("component", list(range(width))).agg(F.sum(value))
    zero = F.lit(0.0)
    cells = [F.coalesce(F.col(f"`{i}`"), zero) for i in range(width)]
    return wide.select(*group, F.array(*cells).cast("array<double>").alias("features"))


def sparse(long: DataFrame, group: tuple[str, ...] = ("key",)) -> DataFrame:
    """(group, features): struct of sorted ``indices`` and their ``values``."""
    pairs = F.sort_array(F.collect_list(
        F.when(F.col("component").isNotNull(), F.struct(F.col("component").cast("int").alias("i"),
                                                        F.col("value").alias("v")))))
    listed = long.groupBy(*group).agg(pairs.alias("_c"))
    return listed.select(*group, F.struct(F.transform("_c", lambda c: c["i"]).alias("indices"),
                                         F.transform("_c", lambda c: c["v"]).alias("values")).alias("features"))


class EncoderEstimator(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """One string column in, one vector column out."""

    dedupe = param("dedupe", "encode distinct strings and join back", TypeConverters.toBoolean)
    handleUnknown = param("handleUnknown", "'ignore' or 'error' for strings not seen in fit")
    defaults: dict = {}

    def __init__(self, **kwargs):
        super().__init__()
        self._setDefault(handleUnknown="ignore", dedupe=True, **self.defaults)
        self._set(**{k: v for k, v in kwargs.items() if v is not None})
        if self.getOrDefault("handleUnknown") not in ("error", "ignore"):
            raise ValueError(f"handleUnknown is 'error' or 'ignore', not {self.getOrDefault('handleUnknown')!r}")

    def get(self, name: str):
        return self.getOrDefault(name)

    def keys(self, df: DataFrame) -> DataFrame:
        """(key, count) of the input column."""
        return df.groupBy(stringify(F.col(self.getInputCol())).alias("key")).agg(
            F.count(F.lit(1)).alias("count"))

    def build(self, model: "EncoderModel") -> "EncoderModel":
        model._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol())
        model.meta.setdefault("handle_unknown", self.get("handleUnknown"))
        model.meta.setdefault("dedupe", self.get("dedupe"))
        return model


class EncoderModel(Model, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """Fitted encoder. Subclasses define :meth:`encode`."""

    def __init__(self, tables: dict[str, DataFrame] | None = None, meta: dict | None = None):
        super().__init__()
        self.tables = dict(tables or {})
        self.meta = dict(meta or {})

    @property
    def width(self) -> int:
        return self.meta["width"]

    def parts(self) -> dict:
        """Attributes that are fitted models themselves; they are saved and loaded with this one."""
        return {}

    def feature_names(self) -> list[str]:
        return self.meta.get("names") or [f"{self.getInputCol()}_{i}" for i in range(self.width)]

    def encode(self, keys: DataFrame) -> DataFrame:
        """(key, ...) distinct strings to (key, features)."""
        raise NotImplementedError

    def encode_long(self, keys: DataFrame) -> DataFrame:
        """(key, component, value) without zeros; keys of zero rows are left out."""
        encoded = self.encode(keys)
        if encoded.schema["features"].dataType.typeName() == "struct":
            return sparse_cells(encoded, ["key"])
        return cells(encoded, ["key"], "features").filter("value <> 0")

    def in_place(self, rows: DataFrame) -> DataFrame | None:
        """Rows encoded without a shuffle, where the model can do so."""
        return None

    def encode_rows(self, rows: DataFrame) -> DataFrame:
        """Add ``features`` to rows that carry ``_key``.

        A table is encoded once per distinct string; a stream, or a column set to
        ``dedupe=False`` because its strings rarely repeat, in place.
        """
        if rows.isStreaming or not self.meta.get("dedupe", True):
            placed = self.in_place(rows)
            if placed is None:
                raise ValueError(f"{type(self).__name__} cannot encode rows in place")
            return placed
        sizes = checkpointed(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")))
        codes = lambda keys: self.encode(keys.withColumnRenamed("_key", "key")).withColumnRenamed("key", "_key")
        return split_join(rows, sizes, "_key", codes, self.width)

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = df.withColumn("_key", stringify(F.col(self.getInputCol())))
        out = self.encode_rows(rows)
        return out.withColumn(self.getOutputCol(), self.as_vector(out)).drop("_key", "features")

    def as_vector(self, encoded: DataFrame) -> Column:
        if encoded.schema["features"].dataType.typeName() == "struct":
            width = self.width
            to_sparse = F.udf(lambda f: SparseVector(width, f["indices"], f["values"]), VectorUDT())
            return to_sparse("features")
        return array_to_vector("features")

    def unknown(self, code: Column, key: Column, fallback: Column) -> Column:
        """Fallback for strings without a code, or an error when so configured."""
        if self.meta.get("handle_unknown") == "error":
            failed = F.raise_error(F.concat(F.lit("not a fitted category: "), key))
            return F.when(code.isNull(), failed).otherwise(code)
        return F.coalesce(code, fallback)

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader()


class _TableWriter(MLWriter):
    def __init__(self, instance: EncoderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        model, cls = self.instance, type(self.instance)
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession, extraMetadata={
            "tables": sorted(model.tables), "meta": json.dumps(model.meta),
            "model": f"{cls.__module__}:{cls.__name__}",
            "parts": {n: f"{type(p).__module__}:{type(p).__name__}" for n, p in model.parts().items()}})
        for name, table in model.tables.items():
            table.write.parquet(f"{path}/tables/{name}")
        for name, part in model.parts().items():
            part.write().save(f"{path}/parts/{name}")


def _class(place: str):
    module, name = place.split(":")
    return getattr(importlib.import_module(module), name)


class _TableReader(MLReader):
    def load(self, path: str) -> EncoderModel:
        loaded = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        tables = {t: self.sparkSession.read.parquet(f"{path}/tables/{t}") for t in loaded["tables"]}
        parts = {n: _class(at).load(f"{path}/parts/{n}") for n, at in loaded.get("parts", {}).items()}
        model = _class(loaded["model"])(tables, json.loads(loaded["meta"]), **parts)
        model._resetUid(loaded["uid"])
        DefaultParamsReader.getAndSetParams(model, loaded)
        return model


def categories_table(estimator: EncoderEstimator, df: DataFrame) -> DataFrame:
    """(key, count) of the fitted categories under the estimator's ``categories`` choice."""
    from lexiloom.operators.prototypes import kmeans_prototypes

    keys = estimator.keys(df)
    choice, n = estimator.get("categories"), estimator.get("nPrototypes")
    if choice == "auto":
        return keys
    if choice == "most_frequent":
        return keys.orderBy(F.desc("count"), "key").limit(n)
    if choice == "k-means":
        if keys.count() <= n:
            warnings.warn(f"all categories are kept: there are no more than {n}")
            return keys
        return kmeans_prototypes(keys, n, estimator.get("seed"))
    if list(choice) != sorted(choice):
        raise ValueError("explicit categories must be sorted")
    explicit = df.sparkSession.createDataFrame([(c,) for c in choice], "key string")
    if estimator.get("handleUnknown") == "error":
        unknown = keys.join(explicit, "key", "left_anti").limit(20).collect()
        if unknown:
            raise ValueError(f"strings outside the explicit categories: {[r['key'] for r in unknown]}")
    return explicit.join(keys, "key", "left").na.fill(0, ["count"])


class HasCategories(Params):
    categories = param("categories", "'auto', 'most_frequent', 'k-means' or a sorted list")
    nPrototypes = param("nPrototypes", "number of prototype categories", TypeConverters.toInt)
    seed = param("seed", "seed of the k-means prototypes", TypeConverters.toInt)
