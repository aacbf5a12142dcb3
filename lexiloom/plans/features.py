"""From a prepared table and its roles to scaled feature vectors and a fold's score."""

from __future__ import annotations

import time

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.lookup import Supervised, training_sums
from lexiloom.operators.metrics import accuracy, average_precision, r2
from lexiloom.operators.models import Scaler, balanced_weights, weighted_by
from lexiloom.operators.reduce import ReducedEncoder
from lexiloom.plans.encoders import column_encoder
from lexiloom.roles import NUMERICAL, ONE_HOT, ONE_HOT_DROP_LAST, SPECIAL, TARGET_ENCODED, ColumnRoles

FEATURES = "features"


def encoder_for(role: str, encoder: str, reduction: str | None, n_components: int | None, column: str, output: str,
                task: str, label: str, vectors: DataFrame | None = None) -> Estimator:
    """The estimator a column's role calls for."""
    if role == SPECIAL:
        return column_encoder(encoder, column, output, reduction, n_components, task=task, label=label, vectors=vectors)
    if role == NUMERICAL:
        return column_encoder("Passthrough", column, output)
    if role in (ONE_HOT, ONE_HOT_DROP_LAST, TARGET_ENCODED):
        return column_encoder(role, column, output, task=task, label=label)
    return column_encoder(role, column, output, n_components=n_components, task=task, label=label, vectors=vectors)


def column_transformer(roles: ColumnRoles, encoder: str, reduction: str | None = None, n_components: int | None = None,
                       vectors: DataFrame | None = None, output: str = "_raw") -> Pipeline:
    """One encoder per feature column, blocks side by side in column order."""
    blocks = {c: f"_block_{i}" for i, c in enumerate(roles.features)}
    stages = [encoder_for(roles.roles[c], encoder, reduction, n_components, c, block, roles.task, roles.target, vectors)
              for c, block in blocks.items()]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=list(blocks.values()), outputCol=output)])


def _supervised(stage: Estimator) -> Supervised | None:
    """The encoder that learns target sums by string, where the stage is one without a reduction."""
    if isinstance(stage, ReducedEncoder) and (stage.method is None or stage.n_components is None):
        stage = stage.encoder
    return stage if isinstance(stage, Supervised) else None


class FoldStatistics:
    """What every training fold's encoders and weights need of the target, from one aggregation per column.

    Rows hold their ``test_folds``. The encoders that learn sums by string, and the class sizes, come from totals less
    the folds' test parts; the other encoders are fitted on the fold's rows.
    """

    def __init__(self, folds: DataFrame, roles: ColumnRoles, n_splits: int, stages: list):
        self.roles, self.sizes = roles, None
        self.models = {i: encoder.fit_folds(folds, n_splits) for i, encoder in enumerate(map(_supervised, stages)) if encoder is not None}
        if roles.task == "binary":
            self.sizes = training_sums(folds.select(roles.target, "test_folds"), [roles.target], [], n_splits)

    def fitted(self, stages: list, fold: int) -> list:
        """The stages with those that are fitted already in their place."""
        return [self.models[i][fold] if i in self.models else stage for i, stage in enumerate(stages)]

    def weighted(self, encoded: DataFrame, fold: int, name: str) -> DataFrame:
        return weighted_by(encoded, self.sizes[fold].withColumnRenamed("n", "_n"), self.roles.target, name)


def multi_encoder(column: str, encoders: list[str], output: str, n_components: int | None = None, **options) -> Pipeline:
    """Several encoders of one column, assembled; the column itself is not copied."""
    blocks = [f"_{column}_{i}" for i in range(len(encoders))]
    stages = [column_encoder(e, column, b, n_components=n_components, **options) for e, b in zip(encoders, blocks)]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=blocks, outputCol=output)])


def feature_pipeline(roles: ColumnRoles, encoder: str, reduction: str | None, n_components: int | None,
                     vectors: DataFrame | None = None) -> Pipeline:
    stages = column_transformer(roles, encoder, reduction, n_components, vectors).getStages()
    return Pipeline(stages=[*stages, Scaler("_raw", FEATURES)])


def score(task: str, predicted: DataFrame, target: str) -> float:
    if task == "regression":
        return float(r2(predicted, target, "prediction").first()[0])
    if task == "multiclass":
        return float(accuracy(predicted, target, "prediction").first()[0])
    column = "probability" if "probability" in predicted.columns else "rawPrediction"
    scored = predicted.select(target, vector_to_array(column)[1].alias("_score")).persist()
    result = float(average_precision(scored, target, "_score").first()[0])
    scored.unpersist()
    return result


def fit_predict_fold(train: DataFrame, test: DataFrame, roles: ColumnRoles, encoder: str, reduction: str | None,
                     n_components: int | None, classifier, fold: int, vectors: DataFrame | None = None,
                     statistics: FoldStatistics | None = None) -> tuple:
    """Fit on train only, score on test: (fold, rows, features, score, encoding s, training s).

    ``classifier`` is called with (task, features, label, width, weight) once the width
    is known. Encoded tables are materialised around the timers. ``statistics`` hold what is known of the training
    rows already.
    """
    began = time.perf_counter()
    pipeline = feature_pipeline(roles, encoder, reduction, n_components, vectors)
    if statistics is not None:
        pipeline = Pipeline(stages=statistics.fitted(pipeline.getStages(), fold))
    encoder_model: PipelineModel = pipeline.fit(train)
    kept = [FEATURES, roles.target]
    encoded = encoder_model.transform(train).select(*kept)
    weight = None
    if roles.task == "binary":
        weight = "weight"
        encoded = balanced_weights(encoded, roles.target, weight) if statistics is None else statistics.weighted(encoded, fold, weight)
    encoded = encoded.persist()
    n_rows = encoded.count()
    width = encoded.select(F.size(vector_to_array(FEATURES))).first()[0]
    encoded_at = time.perf_counter()
    model = classifier(roles.task, FEATURES, roles.target, width, weight).fit(encoded)
    trained_at = time.perf_counter()
    encoded.unpersist()
    predicted = model.transform(encoder_model.transform(test).select(*kept))
    value = score(roles.task, predicted, roles.target)
    return fold, n_rows, width, value, encoded_at - began, trained_at - encoded_at
