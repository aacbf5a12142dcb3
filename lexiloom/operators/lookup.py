"""Encoders whose model is one table joined on the string."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import OneHotEncoder as IndexToVector
from pyspark.ml.param import TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.numeric import finite
from lexiloom.operators.base import EncoderEstimator, EncoderModel, HasCategories, categories_table, param
from lexiloom.operators.prep import stringify
from lexiloom.operators.ranking import dense_ordinals
from lexiloom.session import checkpointed, small, split_join


class _Joined(EncoderModel):
    """Rows look their code up directly: no distinct step, fit for streams too."""

    def encode(self, keys: DataFrame) -> DataFrame:
        rows = keys.select(F.col("key").alias("_key"))
        return self.encode_rows(rows).select(F.col("_key").alias("key"), "features")

    def lookup(self, rows: DataFrame, table: str) -> DataFrame:
        codes = self.tables[table].withColumnRenamed("key", "_key")
        return rows.join(small(codes, self.meta["rows"], self.meta.get("cells", 1)), "_key", "left")


# --- codes computed from a category's place in sorted order ---------------------------


def digits_needed(k: int, base: int) -> int:
    n = 1
    while base ** n <= k:
        n += 1
    return n


def positional_digits(number: Column, base: int, digits: int) -> Column:
    """Digits of a number, most significant first; zero for a missing number."""
    places = [F.floor(number / F.lit(base ** p)) % base for p in reversed(range(digits))]
    return F.array(*[F.coalesce(d, F.lit(0)).cast("double") for d in places])


def sum_contrast(i: Column, j: Column, k: int) -> Column:
    return F.when(i == k - 1, -1.0).when(i == j, 1.0).otherwise(0.0)


def helmert_contrast(i: Column, j: Column, k: int) -> Column:
    return F.when(i <= j, -1.0).when(i == j + 1, (j + 1).cast("double")).otherwise(0.0)


def backward_contrast(i: Column, j: Column, k: int) -> Column:
    return F.when(i <= j, -(F.lit(k) - (j + 1)) / F.lit(float(k))).otherwise((j + 1) / F.lit(float(k)))


CONTRASTS = {"sum": sum_contrast, "helmert": helmert_contrast, "backward": backward_contrast}


# Most levels for polynomial contrasts, whose k x (k - 1) matrix is made on the driver.
MAX_POLYNOMIAL_LEVELS = 2_000


def polynomial_contrasts(k: int) -> np.ndarray:
    """Orthonormal polynomials of degree 1..k-1 on k equally spaced levels, one row each.

    They are the eigenvectors of the tridiagonal matrix of their recurrence, a stable way
    to high degrees; leading coefficients are positive.
    """
    n = np.arange(1, k)
    off = 0.5 * np.sqrt((k ** 2 - n ** 2) / (4 - 1 / n ** 2))
    _, vectors = np.linalg.eigh(np.diag(off, 1) + np.diag(off, -1))
    return (vectors * np.sign(vectors[0])).T[:, 1:]


class OrdinalCodeModel(_Joined):
    """Code as a function of the category's ordinal, evaluated in the projection."""

    def code(self, ordinal: Column) -> Column:
        kind, k = self.meta["kind"], self.meta["k"]
        if kind == "base_n":
            return positional_digits(ordinal + 1, self.meta["base"], self.width)
        formula = CONTRASTS[kind]
        contrast = F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda j: formula(ordinal, j, k))
        if self.meta["intercept"]:
            return F.concat(F.array(F.lit(1.0)), contrast)
        return contrast

    def encode_rows(self, rows: DataFrame) -> DataFrame:
        found = self.lookup(rows, "ordinals")
        ordinal = F.col("ordinal")
        if self.meta["kind"] == "base_n":
            zeros = F.array(*[F.lit(0.0)] * self.width)
        else:
            zeros = F.array_repeat(F.lit(0.0), self.width)
        code = F.when(ordinal.isNotNull(), self.code(ordinal))
        return found.withColumn("features", self.unknown(code, F.col("_key"), zeros)).drop("ordinal")


class _Ordinal(EncoderEstimator):
    def ordinals(self, keys: DataFrame) -> tuple[DataFrame, int]:
        ordinals = checkpointed(dense_ordinals(keys.select("key"), "key"))
        return ordinals, ordinals.count()


class ContrastEncoder(_Ordinal):
    """Sum, Helmert, backward-difference or polynomial contrasts of the sorted levels."""

    kind = param("kind", "sum, helmert, backward or polynomial", TypeConverters.toString)
    intercept = param("intercept", "emit a leading column of ones", TypeConverters.toBoolean)
    defaults = {"kind": "sum", "intercept": False}

    def _fit(self, df):
        if self.get("kind") not in (*CONTRASTS, "polynomial"):
            raise ValueError(f"unknown contrast {self.get('kind')}")
        ordinals, k = self.ordinals(self.keys(df))
        if k < 2:
            raise ValueError("contrasts need at least two categories")
        if self.get("kind") == "polynomial":
            return self._polynomial(ordinals, k)
        meta = {"kind": self.get("kind"), "k": k, "rows": k, "intercept": self.get("intercept"),
                "width": k - 1 + int(self.get("intercept"))}
        return self.build(OrdinalCodeModel({"ordinals": ordinals}, meta))


    def _polynomial(self, ordinals: DataFrame, k: int) -> EncoderModel:
        if k > MAX_POLYNOMIAL_LEVELS:
            raise ValueError(f"polynomial contrasts of {k} levels exceed {MAX_POLYNOMIAL_LEVELS}")
        matrix = polynomial_contrasts(k)
        if self.get("intercept"):
            matrix = np.concatenate((np.ones((k, 1)), matrix), axis=1)
        table = pa.table({"ordinal": pa.array(np.arange(k)), "code": pa.array(list(matrix))})
        codes = ordinals.join(ordinals.sparkSession.createDataFrame(table), "ordinal").select("key", "code")
        width = matrix.shape[1]
        meta = {"rows": k, "cells": width, "width": width, "default": [0.0] * width}
        return self.build(CodeTableModel({"codes": checkpointed(codes)}, meta))


class BaseNEncoder(_Ordinal):
    """1-based place in sorted order, written in base n; unseen strings are 0."""

    base = param("base", "number base", TypeConverters.toInt)
    defaults = {"base": 2}

    def _fit(self, df):
        ordinals, k = self.ordinals(self.keys(df))
        meta = {"kind": "base_n", "base": self.get("base"), "k": k, "rows": k,
                "width": digits_needed(k, self.get("base"))}
        return self.build(OrdinalCodeModel({"ordinals": ordinals}, meta))


class OneHotModel(_Joined):
    """Indicator of the fitted category; sparse, so the width may be large."""

    def feature_names(self):
        rows = self.tables["ordinals"].orderBy("ordinal").limit(self.width).collect()
        return [f"{self.getInputCol()}={r['key']}" for r in rows]

    def _index(self, rows: DataFrame) -> DataFrame:
        found = self.lookup(rows, "ordinals")
        absent = F.lit(self.width)
        index = self.unknown(F.col("ordinal"), F.col("_key"), absent)
        return found.withColumn("_index", F.least(index, absent).cast("double")).drop("ordinal")

    def encode_rows(self, rows: DataFrame) -> DataFrame:
        known = F.col("_index") < self.width
        hit = F.when(known, F.array(F.col("_index").cast("int"))).otherwise(F.array().cast("array<int>"))
        one = F.when(known, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>"))
        features = F.struct(hit.alias("indices"), one.alias("values"))
        return self._index(rows).withColumn("features", features).drop("_index")

    def _transform(self, df: DataFrame) -> DataFrame:
        """The built-in index-to-vector step, told the width by column metadata."""
        indexed = self._index(df.withColumn("_key", stringify(F.col(self.getInputCol()))))
        nominal = {"ml_attr": {"type": "nominal", "name": "_index", "num_vals": self.width + 1}}
        tagged = indexed.withMetadata("_index", nominal)
        to_vector = IndexToVector(inputCols=["_index"], outputCols=[self.getOutputCol()], dropLast=True)
        return to_vector.fit(tagged).transform(tagged).drop("_index", "_key")


class OneHotEncoder(_Ordinal, HasCategories):
    """One column per category in sorted order; unseen strings give zeros."""

    dropLast = param("dropLast", "leave the last category out", TypeConverters.toBoolean)
    defaults = {"dropLast": False, "categories": "auto", "nPrototypes": 0, "seed": 0}

    def _fit(self, df):
        ordinals, k = self.ordinals(categories_table(self, df))
        meta = {"rows": k, "width": k - int(self.get("dropLast"))}
        return self.build(OneHotModel({"ordinals": ordinals}, meta))


class HashCodeModel(EncoderModel):
    """Digest of the string modulo the width: stateless and row-local."""

    def encode(self, keys: DataFrame) -> DataFrame:
        return self.encode_rows(keys.select(F.col("key").alias("_key"))).select(
            F.col("_key").alias("key"), "features")

    def encode_rows(self, rows: DataFrame) -> DataFrame:
        bucket = md5_modulo(F.col("_key"), self.width)
        code = F.transform(F.sequence(F.lit(0), F.lit(self.width - 1)),
                           lambda j: (j == bucket).cast("double"))
        return rows.withColumn("features", code)


def md5_modulo(col: Column, n: int) -> Column:
    """The 128-bit digest as a number, modulo n, eight hex digits at a time."""
    digest = F.md5(col)
    remainder = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        word = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        remainder = (remainder * F.lit(1 << 32) + word) % F.lit(n)
    return remainder


class HashCodeEncoder(EncoderEstimator):
    nComponents = param("nComponents", "number of hash columns", TypeConverters.toInt)
    defaults = {"nComponents": 8}

    def _fit(self, df):
        return self.build(HashCodeModel(meta={"width": self.get("nComponents")}))


# --- codes learned from a target -------------------------------------------------------


class CodeTableModel(_Joined):
    """(key, code) with a default for strings not seen in fit."""

    def encode_rows(self, rows: DataFrame) -> DataFrame:
        default = F.array(*[F.lit(float(v)) for v in self.meta["default"]])
        found = self.lookup(rows, "codes")
        return found.withColumn("features", self.unknown(F.col("code"), F.col("_key"), default)).drop("code")


# Most classes of a target, each of which becomes a column.
MAX_CLASSES = 10_000


class Supervised(EncoderEstimator):
    labelCol = param("labelCol", "target column", TypeConverters.toString)
    task = param("task", "regression, binary or multiclass", TypeConverters.toString)

    def targets(self, df: DataFrame, *kept: str) -> tuple[DataFrame, list]:
        """Rows (key, y0, y1, ..., kept): the target itself, or one 0/1 column per class."""
        key, y = stringify(F.col(self.getInputCol())).alias("key"), F.col(self.get("labelCol"))
        if self.get("task") == "multiclass":
            classes = [r[0] for r in df.select(y).distinct().orderBy(y).limit(MAX_CLASSES + 1).collect()]
            if len(classes) > MAX_CLASSES:
                raise ValueError(f"more than {MAX_CLASSES} classes; is the target numeric?")
            columns = [(y == F.lit(c)).cast("double").alias(f"y{i}") for i, c in enumerate(classes)]
        else:
            classes, columns = [None], [y.cast("double").alias("y0")]
        return df.select(key, *columns, *kept), classes

    def codes(self, table: DataFrame, default: list[float]) -> EncoderModel:
        codes = checkpointed(table)
        meta = {"rows": codes.count(), "cells": len(default), "width": len(default), "default": default}
        return self.build(CodeTableModel({"codes": codes}, meta))

    def _fit(self, df):
        rows, classes = self.targets(df)
        ys = [f"y{i}" for i in range(len(classes))]
        return self.from_sums(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys]), ys)

    def from_sums(self, per_key: DataFrame, ys: list[str]) -> EncoderModel:
        """The model from (key, n, y0, y1, ...): rows and target sums of each string."""
        raise NotImplementedError

    def fit_folds(self, folds: DataFrame, n_splits: int) -> list[EncoderModel]:
        """A model for each fold's training rows, of rows that hold their ``test_folds``.

        The rows are summed once by string and fold; a training fold's sums are the total less its test part.
        """
        rows, classes = self.targets(folds, "test_folds")
        ys = [f"y{i}" for i in range(len(classes))]
        return [self.from_sums(part, ys) for part in training_sums(rows, ["key"], ys, n_splits)]


def training_sums(rows: DataFrame, group: list[str], ys: list[str], n_splits: int) -> list[DataFrame]:
    """For each fold (group, n, ys) of the rows outside its test part, from one aggregation of (group, ys, test_folds).

    Rows are added up per task by group and fold before they are shuffled. Groups without training rows are left out.
    """
    every = F.explode(F.concat(F.array(F.lit(-1)), F.col("test_folds"))).alias("fold")
    sums = rows.select(*group, *ys, every).groupBy(*group, "fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys])
    by_fold = F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", *ys).alias("s")))).alias("_sums")
    held = checkpointed(sums.groupBy(*group).agg(by_fold))

    def left(fold: int, name: str) -> Column:
        part = F.try_element_at("_sums", F.lit(fold))[name]
        return (F.try_element_at("_sums", F.lit(-1))[name] - F.coalesce(part, F.lit(0))).alias(name)

    return [held.select(*group, left(f, "n"), *[left(f, y) for y in ys]).filter("n > 0") for f in range(n_splits)]


class TargetMeanEncoder(Supervised):
    """Target mean of the category shrunk towards the overall mean.

    The weight of a category's own mean is n_x / (n_x + n / k) for n rows and k
    categories; multiclass targets give one column per class.
    """

    defaults = {"labelCol": "y", "task": "regression"}

    def from_sums(self, per_key, ys):
        total = per_key.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
                            *[F.sum(y).alias(y) for y in ys]).first()
        means = [total[y] / total["n"] for y in ys]
        weight = F.col("n") / (F.col("n") + F.lit(total["n"] / total["k"]))
        code = F.array(*[weight * F.col(y) / F.col("n") + (1 - weight) * F.lit(m)
                         for y, m in zip(ys, means)])
        return self.codes(per_key.select("key", code.alias("code")), means)


class ClassFrequencyEncoder(Supervised):
    """P(string | class) for each class in sorted order; zeros for unseen strings."""

    defaults = {"labelCol": "y", "task": "multiclass"}

    def targets(self, df, *kept):
        if self.get("task") == "regression":
            raise ValueError("class frequencies need a classification target")
        return super(ClassFrequencyEncoder, self.copy({self.task: "multiclass"})).targets(df, *kept)

    def from_sums(self, per_key, ys):
        total = per_key.agg(*[F.sum(y).alias(y) for y in ys]).first()
        # A class without training rows has no strings.
        code = F.array(*[F.col(y) / F.lit(total[y]) if total[y] else F.lit(0.0) for y in ys])
        return self.codes(per_key.select("key", code.alias("code")), [0.0] * len(ys))


class LeaveOneOutEncoder(Supervised):
    """Target mean by category; strings seen once or never take the overall mean."""

    defaults = {"labelCol": "y", "task": "regression"}

    def from_sums(self, per_key, ys):
        total = per_key.agg(F.sum("n").alias("n"), F.sum("y0").alias("s")).first()
        mean = total["s"] / total["n"]
        value = F.when(F.col("n") > 1, F.col("y0") / F.col("n")).otherwise(F.lit(mean))
        return self.codes(per_key.select("key", F.array(value).alias("code")), [mean])


def leave_one_out_train(df: DataFrame, column: str, target: str, name: str) -> DataFrame:
    """Training form: each row gets the mean of its category's *other* rows.

    Sums are pre-aggregated and joined, so a category holding much of the table never
    meets in one window partition; heavy categories' rows are not shuffled at all.
    """
    y = F.col(target).cast("double")
    keyed = df.withColumn("_key", stringify(F.col(column)))
    sums = checkpointed(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_s")))
    overall = sums.agg((F.sum("_s") / F.sum("_n"))).scalar()
    value = F.when(F.col("_n") > 1, (F.col("_s") - y) / (F.col("_n") - 1)).otherwise(overall)
    joined = split_join(keyed, sums, "_key", lambda keys: keys.join(sums, "_key"), 3)
    return joined.withColumn(name, value).drop("_key", "_n", "_s")


class PassthroughModel(EncoderModel):
    """A finite number as a vector of width one."""

    def _transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        x = F.col(self.getInputCol())
        failed = F.raise_error(F.concat(F.lit(f"{self.getInputCol()} holds a value that is not finite: "),
                                        F.coalesce(x.cast("string"), F.lit("null"))))
        checked = F.when(finite(x), x.cast("double")).otherwise(failed.cast("double"))
        return df.withColumn(self.getOutputCol(), array_to_vector(F.array(checked)))


class PassthroughEncoder(EncoderEstimator):
    def _fit(self, df):
        return self.build(PassthroughModel(meta={"width": 1, "names": [self.getInputCol()]}))
