"""Scores of predictions, each computed by aggregation."""

from __future__ import annotations

from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.ranking import running_sums

# Score name of each task.
SCORE_NAMES = {"regression": "r2", "binary": "av-prec", "multiclass": "accuracy"}


def r2(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """One row: 1 - residual sum of squares / total sum of squares.

    A constant target scores 1 when it is met exactly and 0 otherwise.
    """
    y, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    residual, total = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)
    flat = F.when(residual == 0, 1.0).otherwise(0.0)
    return df.agg(F.coalesce(1 - F.try_divide(residual, total), flat).alias("r2"))


def accuracy(df: DataFrame, target: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(target) == F.col(prediction)).cast("double")).alias("accuracy"))


def average_precision(df: DataFrame, target: str, score: str) -> DataFrame:
    """One row: sum over distinct scores of the recall step times the precision.

    Without any positive row the score is 0. A null or NaN score is an error.
    Rows collapse to distinct scores first; the running sums over them are distributed.
    """
    positive = F.col(target).cast("double")
    value = F.col(score).cast("double")
    known = F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit(f"column {score} holds a null or NaN score"))
                   .cast("double")).otherwise(value)
    points = df.select(known.alias("_s"), F.col(target)).groupBy("_s").agg(
        F.sum(positive).alias("hits"), F.count(F.lit(1)).cast("double").alias("rows"))
    curve = running_sums(points, "_s", ["hits", "rows"], descending=True)
    area = F.try_divide(F.sum(F.col("hits") * F.col("cum_hits") / F.col("cum_rows")), F.sum("hits"))
    return curve.agg(F.coalesce(area, F.lit(0.0)).alias("average_precision"))


class AveragePrecisionEvaluator(Evaluator):
    """Average precision of the probability of class 1, for grid searches."""

    def __init__(self, labelCol: str = "label", probabilityCol: str = "probability"):
        super().__init__()
        self.label, self.probability = labelCol, probabilityCol

    def _evaluate(self, df: DataFrame) -> float:
        scored = df.select(F.col(self.label), vector_to_array(self.probability)[1].alias("_p"))
        return float(average_precision(scored, self.label, "_p").first()[0])

    def isLargerBetter(self) -> bool:
        return True


def evaluator(task: str, label: str) -> Evaluator:
    if task == "regression":
        return RegressionEvaluator(labelCol=label, metricName="r2")
    if task == "binary":
        return AveragePrecisionEvaluator(label)
    if task == "multiclass":
        return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    raise ValueError(f"unknown task {task!r}")
