"""Dimensionality reduction of an encoder's output, on distinct strings.

Every method yields a table of directions (component, w). Projecting is then a join on
the component and a sum per string, so neither a dense string x feature matrix nor the
directions as a whole have to fit in one place.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.param import Params
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.arrays import cells
from lexiloom.operators.base import EncoderModel
from lexiloom.operators.kernels import StructuredModel
from lexiloom.operators.subspace import leading, multiplied
from lexiloom.session import BROADCAST_CELLS, checkpointed, small

# Seeds of the reductions.
PROJECTION_SEED = 35
# Cells (entries x directions) multiplied at once.
CELLS_AT_ONCE = 4_000_000
METHODS = (None, "GaussianRandomProjection", "TruncatedSVD", "most_frequent", "k-means", "PCA")


def _unit(parts: Column, start: int) -> Column:
    """A number in (0, 1) from 13 hex digits of a digest."""
    return (F.conv(F.substring(parts, start, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16 ** 13))


def gaussian_directions(spark: SparkSession, width: int, k: int, seed: int = PROJECTION_SEED) -> DataFrame:
    """N(0, 1/k) entries drawn from the digest of (seed, component, direction)."""
    component = F.col("component")

    def entry(j: int) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), component.cast("string"), F.lit(str(j))))
        radius = F.sqrt(-2.0 * F.ln(_unit(digest, 1)))
        return radius * F.cos(F.lit(2 * np.pi) * _unit(digest, 14)) / F.lit(float(np.sqrt(k)))

    return spark.range(width).withColumnRenamed("id", "component").select(
        "component", F.array(*[entry(j) for j in range(k)]).alias("w"))


def svd_directions(weighted: DataFrame, width: int, k: int) -> DataFrame:
    """Top right singular vectors of (count, features), a row counting ``count`` times."""
    return leading(weighted, width, k).directions


def pca_directions(weighted: DataFrame, width: int, k: int) -> tuple[DataFrame, list[float]]:
    """Principal directions, and what the mean projects to on each."""
    found = leading(weighted, width, k, centre=True)
    return found.directions, found.shift


def project(long: DataFrame, directions: DataFrame, width: int, k: int) -> DataFrame:
    """(key, component, value) to (key, features) of length k.

    Rows are added up per task before they are dealt by key.
    """
    joined = long.join(small(directions, width, k), "component")
    sums = joined.groupBy("key").agg(*[F.sum(F.col("value") * F.col("w")[j]).alias(f"s{j}") for j in range(k)])
    return sums.select("key", F.array(*[f"s{j}" for j in range(k)]).alias("features"))


def projected(features: Column, directions: np.ndarray, present: np.ndarray, sparse: bool, spark: SparkSession) -> Column:
    """Codes times directions of a bounded size, row by row without a shuffle.

    ``present`` holds the components of the directions' rows, ascending; other components count nothing.
    """
    sent = spark.sparkContext.broadcast((directions, present))

    @F.arrow_udf("array<double>")
    def times(codes: pa.Array) -> pa.Array:
        w, known = sent.value
        k = w.shape[1]
        lists = codes.field("values") if sparse else codes
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        values = lists.flatten().to_numpy(zero_copy_only=False)
        index = (codes.field("indices").flatten().to_numpy(zero_copy_only=False) if sparse
                 else np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        row = np.repeat(np.arange(len(codes)), sizes)
        place = np.searchsorted(known, index)
        met = np.flatnonzero(place < len(known))
        met = met[known[place[met]] == index[met]]
        out = np.zeros((len(codes), k))
        for some in np.array_split(met, 1 + len(met) * k // CELLS_AT_ONCE):
            if len(some):
                own, first = np.unique(row[some], return_index=True)
                out[own] += np.add.reduceat(values[some, None] * w[place[some]], first, axis=0)
        offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * k, type=pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return times(features)


class ReducedModel(EncoderModel):
    """An encoder followed by a projection, both on distinct strings.

    Directions of a checked size are sent to the rows, which works in place and on streams too; of larger ones, blocks
    of rows get their components' part.
    """

    def __init__(self, tables=None, meta=None, inner: EncoderModel | None = None):
        super().__init__(tables, meta)
        self.inner = inner

    @property
    def local(self) -> bool:
        return self.inner.width * self.width <= BROADCAST_CELLS

    def _sent(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_rows"):
            rows = self.tables["directions"].orderBy("component").toArrow()
            self._rows = (np.array(rows["w"].combine_chunks().flatten()).reshape(rows.num_rows, self.width), rows["component"].to_numpy())
        return self._rows

    def _shifted(self, features: Column) -> Column:
        shift = F.array(*[F.lit(float(s)) for s in self.meta["shift"]])
        return F.zip_with(features, shift, lambda x, s: x - s)

    def _placed(self, encoded: DataFrame) -> DataFrame:
        sparse = encoded.schema["features"].dataType.typeName() == "struct"
        out = projected(F.col("features"), *self._sent(), sparse, encoded.sparkSession)
        return encoded.withColumn("features", self._shifted(out))

    def _kernels(self, keys: DataFrame) -> DataFrame:
        """Kernels' directions are added up by n-gram, so that no string is paired with all categories."""
        if not hasattr(self, "_terms"):
            self._terms = self.inner.term_products(self.tables["directions"], self.width)
        found = self.inner.products(keys, self._terms, self.width)
        return found.select("key", self._shifted(self._structured(F.col("features"), F.col("offset"), F.col("scale"))).alias("features"))

    def _structured(self, products: Column, offset: Column, scale: Column) -> Column:
        """Products of a code's sparse part with what its two numbers add: their row's sums come from tables once."""
        if not hasattr(self, "_rows_of_numbers"):
            joined = self.tables["directions"].join(self.inner.tables["constants"], "component")
            sums = [F.sum(F.col("w")[j]) for j in range(self.width)] + [F.sum(F.col("w")[j] * F.col("constant")) for j in range(self.width)]
            found = [x or 0.0 for x in joined.agg(*sums).first()]
            self._rows_of_numbers = found[:self.width], found[self.width:]
        ones, constants = (F.array(*[F.lit(float(x)) for x in row]) for row in self._rows_of_numbers)
        return F.zip_with(F.zip_with(products, ones, lambda p, x: p + offset * x), constants, lambda p, x: p + scale * x)

    def encode(self, keys: DataFrame) -> DataFrame:
        if isinstance(self.inner, StructuredModel):
            return self._kernels(keys)
        if self.local:
            return self._placed(self.inner.encode(keys)).select("key", "features")
        found = multiplied(self.inner.encode(keys), self.tables["directions"], self.width)
        return found.select("key", self._shifted(F.col("features")).alias("features"))

    def in_place(self, rows: DataFrame) -> DataFrame | None:
        placed = self.inner.in_place(rows) if self.local else None
        return None if placed is None else self._placed(placed)

    def parts(self) -> dict:
        return {"inner": self.inner}


class ReducedEncoder(Estimator, Params):
    """Fit an encoder, then a reduction unless its output is narrow already."""

    def __init__(self, encoder: Estimator, method: str | None, n_components: int | None,
                 seed: int = PROJECTION_SEED):
        super().__init__()
        if method not in METHODS:
            raise ValueError(f"unknown reduction {method!r}; known are {METHODS}")
        self.encoder, self.method, self.n_components, self.seed = encoder, method, n_components, seed

    def _fit(self, df: DataFrame):
        inner = self.encoder.fit(df)
        k = self.n_components
        if self.method in (None, "most_frequent", "k-means") or k is None:
            return inner
        if inner.width <= k:
            warnings.warn(
                f"no reduction needed: the code has {inner.width} components, {k} were asked for")
            return inner
        shift = [0.0] * k
        if self.method == "GaussianRandomProjection":
            directions = gaussian_directions(df.sparkSession, inner.width, k, self.seed)
        else:
            keys = self.encoder.keys(df)
            # Rows that are coded where they lie keep their count; codes may be far larger than what a join would sort.
            placed = None if isinstance(inner, StructuredModel) else inner.in_place(keys.withColumn("_key", F.col("key")))
            if placed is None:
                coded = inner.encode(keys.select("key"))
                if isinstance(inner, StructuredModel):
                    coded = coded.withColumn("features", inner.written_out(F.col("features"), df.sparkSession))
                placed = coded.join(keys, "key")
            weighted = placed.select("key", "count", "features")
            if self.method == "TruncatedSVD":
                directions = svd_directions(weighted, inner.width, k)
            else:
                directions, shift = pca_directions(weighted, inner.width, k)
        model = ReducedModel({"directions": checkpointed(directions)}, {"width": k, "shift": shift}, inner)
        return self.encoder.build(model)
