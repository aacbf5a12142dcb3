"""Scaling, kernel approximation and the estimators offered for each task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
)
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.base import param
from lexiloom.operators.lookup import training_sums
from lexiloom.operators.metrics import evaluator
from lexiloom.operators.ranking import lowest
from lexiloom.operators.ridge import N_FOLDS, RidgeCV
from lexiloom.session import settled

# Tuning grids and network shapes.
LEARNING_RATES_LEAVES = (0.1, 0.05, 0.5)
LEAVES = (7, 15, 31)
LEARNING_RATES_DEPTH = (0.1, 0.05, 0.3)
DEPTHS = (3, 6, 9)
MLP_RATES = (0.001, 0.0005, 0.005)
MLP_LAYERS = ((30,), (50,), (100,), (30, 30), (50, 50), (100, 100))
NYSTROEM_COMPONENTS = (1000, 3000)
NYSTROEM_DEGREES = (2, 3)
N_TREES = 100
LOGISTIC_PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)
# Largest landmark matrix (landmarks x features) kept on the driver and broadcast.
MAX_LANDMARK_CELLS = 40_000_000

CLASSIFIERS = ("L2RegularizedLinearModel", "GradientBoosting", "LGBM", "XGB", "MLP", "MLPGridSearchCV",
               "NystroemRidgeCV")


class Scaler(Estimator, HasInputCol, HasOutputCol):
    """Divide each feature by its population deviation; constant features stay as is."""

    def __init__(self, inputCol: str, outputCol: str):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _fit(self, df: DataFrame) -> Transformer:
        stats = Summarizer.metrics("variance", "count")
        row = df.select(stats.summary(F.col(self.getInputCol())).alias("s")).select("s.variance", "s.count").first()
        n = row["count"]
        sd = np.sqrt(row["variance"].toArray() * (n - 1) / n)
        factors = 1 / np.where(sd > 0, sd, 1.0)
        return ElementwiseProduct(scalingVec=Vectors.dense(factors), inputCol=self.getInputCol(),
                                  outputCol=self.getOutputCol())


def scale_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same for plain columns."""
    row = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.col(c) / F.lit(row[c] or 1.0) for c in columns})


def fold_deviations(folds: DataFrame, columns: list[str], n_splits: int) -> list[dict[str, float]]:
    """Population deviations of plain columns on each fold's training rows, from one aggregation.

    Squares are taken around the columns' overall means, so that totals less parts stay exact enough.
    """
    means = folds.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns]).first()
    apart = {c: F.col(c).cast("double") - F.lit(means[c]) for c in columns}
    rows = folds.select("test_folds", F.lit(0).alias("all"), *[x.alias(f"s_{c}") for c, x in apart.items()],
                        *[(x * x).alias(f"q_{c}") for c, x in apart.items()])
    out = []
    for part in training_sums(rows, ["all"], [f"{k}_{c}" for k in "sq" for c in columns], n_splits):
        row = part.first()
        out.append({c: float(np.sqrt(max(row[f"q_{c}"] / row["n"] - (row[f"s_{c}"] / row["n"]) ** 2, 0.0))) if row else 0.0
                    for c in columns})
    return out


def balanced_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """Add n / (C * n_class); class sizes are aggregated first and joined."""
    return weighted_by(df, df.groupBy(target).agg(F.count(F.lit(1)).alias("_n")), target, name)


def weighted_by(df: DataFrame, sizes: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """The same for given class sizes (target, _n)."""
    weight = (sizes.agg(F.sum("_n") / F.count(F.lit(1))).scalar() / F.col("_n")).alias(name)
    return df.join(settled(sizes.select(target, weight)), target)


def _kernel(x: np.ndarray, basis: np.ndarray, s: dict) -> np.ndarray:
    if s["kernel"] == "polynomial":
        return (s["gamma"] * (x @ basis.T) + s["coef0"]) ** s["degree"]
    square = (x ** 2).sum(axis=1)[:, None] + (basis ** 2).sum(axis=1)[None, :] - 2 * x @ basis.T
    return np.exp(-np.maximum(square, 0) / (2 * s["bandwidth"] ** 2))


class NystroemModel(Model, HasInputCol, HasOutputCol):
    def __init__(self, basis: np.ndarray, normalizer: np.ndarray, settings: dict):
        super().__init__()
        self.basis, self.normalizer, self.settings = basis, normalizer, settings

    def _transform(self, df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast((self.basis, self.normalizer, self.settings))

        @F.arrow_udf("array<double>")
        def features(lists: pa.Array) -> pa.Array:
            basis, normalizer, settings = sent.value
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), basis.shape[1])
            out = _kernel(x, basis, settings) @ normalizer
            offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], type=pa.int32())
            return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

        return df.withColumn(self.getOutputCol(), array_to_vector(features(vector_to_array(self.getInputCol()))))


class Nystroem(Estimator, HasInputCol, HasOutputCol):
    """Low-rank kernel features from a seeded sample of landmark rows."""

    nComponents = param("nComponents", "number of landmarks", TypeConverters.toInt)
    degree = param("degree", "degree of the polynomial kernel", TypeConverters.toInt)
    kernel = param("kernel", "polynomial or gaussian", TypeConverters.toString)
    bandwidth = param("bandwidth", "width of the gaussian kernel", TypeConverters.toFloat)
    seed = param("seed", "seed of the landmark sample", TypeConverters.toInt)

    def __init__(self, **kwargs):
        super().__init__()
        self._setDefault(nComponents=100, degree=2, kernel="polynomial", bandwidth=5.0, seed=0)
        self._set(**kwargs)

    def _fit(self, df: DataFrame) -> NystroemModel:
        g = self.getOrDefault
        if g("kernel") not in ("polynomial", "gaussian"):
            raise ValueError(f"unknown kernel {g('kernel')}")
        x = vector_to_array(self.getInputCol()).alias("x")
        # Equal rows give equal digests: distinct rows make the landmark order total.
        rows = df.select(x).distinct()
        width = rows.select(F.size("x")).first()[0]
        if g("nComponents") * width > MAX_LANDMARK_CELLS:
            raise ValueError(f"{g('nComponents')} landmarks of {width} features exceed {MAX_LANDMARK_CELLS} cells")
        order = F.md5(F.concat_ws("|", F.transform("x", lambda v: v.cast("string")), F.lit(str(g("seed")))))
        few = lowest(rows, [], order, ["x"], F.lit(g("nComponents"))).collect()
        basis = np.array(sorted(r["x"] for r in few))
        settings = {"kernel": g("kernel"), "degree": g("degree"), "gamma": 1 / width, "coef0": 1.0,
                    "bandwidth": g("bandwidth")}
        values, vectors = np.linalg.eigh(_kernel(basis, basis, settings))
        normalizer = vectors / np.sqrt(np.maximum(values, 1e-12)) @ vectors.T
        model = NystroemModel(basis, normalizer, settings)
        return model._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol())


def cross_validated(estimator: Estimator, grid: list, task: str, label: str, seed: int, parallelism: int = 4) -> CrossValidator:
    return CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator(task, label),
                          numFolds=N_FOLDS, seed=seed, parallelism=parallelism)


class BestOf(Estimator, Params):
    """A tuned estimator whose fit is the winner itself, usable as a pipeline stage."""

    def __init__(self, search: CrossValidator):
        super().__init__()
        self.search = search

    def _fit(self, df: DataFrame) -> Model:
        # Each fold's parts and the last fit would compute the rows' features again.
        kept = df.persist()
        try:
            return self.search.fit(kept).bestModel
        finally:
            kept.unpersist()


def linear_model(task: str, features: str, label: str, weight: str | None, seed: int) -> Estimator:
    """L2-penalised linear model, penalty chosen by 3-fold cross-validation."""
    if task == "regression":
        return RidgeCV(featuresCol=features, labelCol=label, seed=seed)
    logistic = LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", maxIter=100)
    if weight is not None:
        logistic = logistic.setWeightCol(weight)
    grid = ParamGridBuilder().addGrid(logistic.regParam, LOGISTIC_PENALTIES).build()
    return BestOf(cross_validated(logistic, grid, task, label, seed))


def boosting(task: str, features: str, label: str, seed: int, trees: int = N_TREES):
    """(estimator, boosted-tree learner whose params a grid can vary)."""
    if task == "regression":
        gbt = GBTRegressor(featuresCol=features, labelCol=label, maxIter=trees, maxDepth=3, seed=seed)
        return gbt, gbt
    gbt = GBTClassifier(featuresCol=features, labelCol=label, maxIter=trees, maxDepth=3, seed=seed)
    if task == "binary":
        return gbt, gbt
    return OneVsRest(classifier=gbt, featuresCol=features, labelCol=label), gbt


def boosting_grid(task: str, features: str, label: str, seed: int, rates, depths, trees: int = N_TREES) -> CrossValidator:
    estimator, gbt = boosting(task, features, label, seed, trees)
    if estimator is gbt:
        grid = ParamGridBuilder().addGrid(gbt.stepSize, rates).addGrid(gbt.maxDepth, depths).build()
    else:
        variants = [gbt.copy({gbt.stepSize: r, gbt.maxDepth: d}) for r in rates for d in depths]
        grid = ParamGridBuilder().addGrid(estimator.classifier, variants).build()
    return cross_validated(estimator, grid, task, label, seed)


def leaves_to_depth(leaves: int) -> int:
    return int(np.ceil(np.log2(leaves)))


def mlp(features: str, label: str, width: int, classes: int, hidden=(30, 30), seed: int = 0) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, maxIter=200, seed=seed,
                                          layers=[width, *hidden, classes])


def mlp_grid(task: str, features: str, label: str, width: int, classes: int, seed: int,
             rates=MLP_RATES, shapes=MLP_LAYERS) -> CrossValidator:
    # Only gradient descent has a learning rate; the default solver would ignore the grid's.
    network = mlp(features, label, width, classes, seed=seed).setSolver("gd")
    grid = (ParamGridBuilder().addGrid(network.stepSize, rates)
            .addGrid(network.layers, [[width, *shape, classes] for shape in shapes]).build())
    return cross_validated(network, grid, task, label, seed)


def nystroem_linear(task: str, features: str, label: str, weight: str | None, seed: int,
                    components=NYSTROEM_COMPONENTS, degrees=NYSTROEM_DEGREES) -> CrossValidator:
    approx = Nystroem(inputCol=features, outputCol="_kernel", seed=seed)
    pipeline = Pipeline(stages=[approx, linear_model(task, "_kernel", label, weight, seed)])
    grid = ParamGridBuilder().addGrid(approx.nComponents, components).addGrid(approx.degree, degrees).build()
    return cross_validated(pipeline, grid, task, label, seed, parallelism=2)


def build_estimator(name: str, task: str, features: str, label: str, width: int, classes: int = 2,
                    weight: str | None = None, seed: int = 0) -> Estimator:
    """The estimator a classifier name stands for."""
    evaluator(task, label)
    if name == "L2RegularizedLinearModel":
        return linear_model(task, features, label, weight, seed)
    if name == "GradientBoosting":
        return boosting(task, features, label, seed)[0]
    if name == "LGBM":
        depths = sorted({leaves_to_depth(n) for n in LEAVES})
        return boosting_grid(task, features, label, seed, LEARNING_RATES_LEAVES, depths)
    if name == "XGB":
        return boosting_grid(task, features, label, seed, LEARNING_RATES_DEPTH, DEPTHS)
    if name in ("MLP", "MLPGridSearchCV") and task == "regression":
        raise ValueError("multilayer perceptrons are offered for classification only")
    if name == "MLP":
        return mlp(features, label, width, classes, seed=seed)
    if name == "MLPGridSearchCV":
        return mlp_grid(task, features, label, width, classes, seed)
    if name == "NystroemRidgeCV":
        return nystroem_linear(task, features, label, weight, seed)
    raise ValueError(f"no classifier is named {name!r}; known are {', '.join(CLASSIFIERS)}")
