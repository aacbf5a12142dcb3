"""Ridge regression whose penalty is chosen by cross-validation, from one pass over the rows.

Every task adds up, for each fold, the products of its rows' features, a one and the target. A training fold's matrix is
the total less the fold's own part, so the normal equations of every fold and penalty, and each fold's score, follow
from these sums without another look at the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.base import param

# Penalties tried, and folds of the search.
RIDGE_PENALTIES = (0.1, 1.0, 10.0)
N_FOLDS = 3
# Widest features whose sums by fold (3 x 134 MB) come to the driver; wider ones are fitted by Spark's own solver.
GRAM_WIDTH = 4096


def sums_by_fold(df: DataFrame, x: Column, y: Column, fold: Column, width: int, folds: int) -> np.ndarray:
    """For each fold the (d + 2) x (d + 2) sums of products of its rows (features, 1, target)."""
    size = width + 2

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, size, size))
        for batch in batches:
            rows = np.ones((batch.num_rows, size))
            rows[:, :width] = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            rows[:, -1] = batch.column("y").to_numpy(zero_copy_only=False)
            which = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in range(folds):
                own = rows[which == f]
                total[f] += own.T @ own
        offsets = pa.array(np.arange(folds * size + 1, dtype=np.int32) * size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(folds * size)), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))],
                                         ["place", "row"])

    parts = df.select(x.alias("x"), y.cast("double").alias("y"), fold.cast("int").alias("fold")).mapInArrow(add, "place long, row array<double>")
    cells = parts.select("place", F.posexplode("row").alias("i", "v")).groupBy("place", "i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((folds * size, size))
    out[cells["place"].to_numpy(), cells["i"].to_numpy()] = cells["v"].to_numpy()
    return out.reshape(folds, size, size)


def solve(sums: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of least squares plus ``penalty`` times the squared coefficients."""
    n = sums[-2, -2]
    if not n:
        return np.zeros(len(sums) - 2), 0.0
    mean, y = sums[:-2, -2] / n, sums[-1, -2] / n
    gram = sums[:-2, :-2] - n * np.outer(mean, mean)
    w = np.linalg.lstsq(gram + penalty * np.eye(len(gram)), sums[:-2, -1] - n * mean * y, rcond=None)[0]
    return w, float(y - mean @ w)


def r2_of(sums: np.ndarray, w: np.ndarray, intercept: float) -> float:
    """The score on the rows that were summed; a constant target scores 1 when it is met and 0 otherwise."""
    error = np.concatenate((w, [intercept, -1.0]))
    n, residual = sums[-2, -2], max(float(error @ sums @ error), 0.0)
    total = float(sums[-1, -1] - sums[-1, -2] ** 2 / n) if n else 0.0
    return 1 - residual / total if total > 0 else float(residual == 0)


class RidgeModel(Model, HasFeaturesCol, HasPredictionCol):
    """Predictions x w + b; ``penalty`` is the chosen one and ``scores`` the mean score of each."""

    def __init__(self, coefficients: np.ndarray, intercept: float, penalty: float, scores: list[float]):
        super().__init__()
        self.coefficients, self.intercept, self.penalty, self.scores = coefficients, intercept, penalty, scores

    def _transform(self, df: DataFrame) -> DataFrame:
        w, b = self.coefficients, self.intercept

        @F.arrow_udf("double")
        def predict(rows: pa.Array) -> pa.Array:
            return pa.array(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(w)) @ w + b)

        return df.withColumn(self.getPredictionCol(), predict(vector_to_array(self.getFeaturesCol())))


class RidgeCV(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, Params):
    """Least squares with a penalty on the squared coefficients (not the intercept), best by mean r2 over the folds.

    A row's fold is its ``foldCol`` (0 to ``folds`` - 1) or else a digest of its values, so equal rows share a fold.
    """

    foldCol = param("foldCol", "column with each row's fold", TypeConverters.toString)
    folds = param("folds", "folds of the search", TypeConverters.toInt)
    penalties = param("penalties", "penalties tried", TypeConverters.toListFloat)
    seed = param("seed", "seed of the folds", TypeConverters.toInt)

    def __init__(self, **kwargs):
        super().__init__()
        self._setDefault(folds=N_FOLDS, penalties=list(RIDGE_PENALTIES), seed=0)
        self._set(**kwargs)

    def _fit(self, df: DataFrame) -> Model:
        g, x, y = self.getOrDefault, vector_to_array(self.getFeaturesCol()), F.col(self.getLabelCol())
        first = df.select(F.size(x)).first()
        width = first[0] if first else 0
        if width > GRAM_WIDTH:
            return self._wide(df)
        fold = F.col(g("foldCol")) if self.isSet("foldCol") else F.pmod(F.xxhash64(x, y, F.lit(g("seed"))), F.lit(g("folds")))
        sums = sums_by_fold(df, x, y, fold, width, g("folds"))
        total = sums.sum(axis=0)
        scores = [float(np.mean([r2_of(part, *solve(total - part, p)) for part in sums])) for p in g("penalties")]
        penalty = g("penalties")[int(np.argmax(scores))]
        model = RidgeModel(*solve(total, penalty), penalty, scores)
        return model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())

    def _wide(self, df: DataFrame) -> Model:
        """The same objective by Spark's solver, whose penalty is per row and in units of the target's deviation."""
        from lexiloom.operators.models import cross_validated

        solver = LinearRegression(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol(),
                                  elasticNetParam=0.0, standardization=False, solver="l-bfgs", tol=1e-9, maxIter=300)
        rows, deviation = df.agg(F.count(F.lit(1)), F.coalesce(F.nullif(F.stddev(self.getLabelCol()), F.lit(0.0)), F.lit(1.0))).first()
        grid = ParamGridBuilder().addGrid(solver.regParam, [p * deviation / rows for p in self.getOrDefault("penalties")]).build()
        return cross_validated(solver, grid, "regression", self.getLabelCol(), self.getOrDefault("seed")).fit(df).bestModel
