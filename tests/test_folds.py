"""Statistics of training folds from totals less test parts, against refits on the folds' rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators.lookup import ClassFrequencyEncoder, LeaveOneOutEncoder, TargetMeanEncoder
from lexiloom.operators.models import balanced_weights, fold_deviations
from lexiloom.operators.splits import shuffle_folds
from lexiloom.plans.features import FoldStatistics, feature_pipeline
from lexiloom.roles import ColumnRoles

N = 4


@pytest.fixture(scope="module")
def folds(spark):
    rng = np.random.RandomState(3)
    rows = [(i, None if i % 17 == 0 else f"k{rng.randint(9) if i < 80 else i}", "hot" if i % 10 else "cold", float(rng.normal(50, 9)),
             int(rng.randint(3)), int(rng.randint(2))) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, s string, h string, v double, c int, b int")
    return shuffle_folds(df, ["id"], N, 1 / 3, 5).cache()


def codes(model):
    return {r["key"]: r["code"] for r in model.tables["codes"].collect()}


@pytest.mark.parametrize("make", [
    lambda: TargetMeanEncoder(inputCol="s", outputCol="o", labelCol="v"),
    lambda: TargetMeanEncoder(inputCol="h", outputCol="o", labelCol="v"),
    lambda: TargetMeanEncoder(inputCol="s", outputCol="o", labelCol="c", task="multiclass"),
    lambda: LeaveOneOutEncoder(inputCol="s", outputCol="o", labelCol="v"),
    lambda: ClassFrequencyEncoder(inputCol="s", outputCol="o", labelCol="c")])
def test_encoders_of_all_folds_equal_refits(folds, make):
    for fold, model in enumerate(make().fit_folds(folds, N)):
        again = make().fit(folds.filter(~F.array_contains("test_folds", fold)))
        got, want = codes(model), codes(again)
        assert got.keys() == want.keys() and np.allclose(model.meta["default"], again.meta["default"])
        assert all(np.allclose(got[k], want[k]) for k in want)


def test_deviations(folds):
    found = fold_deviations(folds, ["v", "c"], N)
    for fold, own in enumerate(found):
        rows = folds.filter(~F.array_contains("test_folds", fold)).select("v", "c").collect()
        assert np.allclose([own["v"], own["c"]], np.std(np.array(rows, float), axis=0))


def test_benchmark_statistics(folds):
    roles = ColumnRoles({"s": "TargetEncoder", "h": "OneHotEncoderDense", "v": "Numerical", "b": "y"}, "binary")
    stages = feature_pipeline(roles, "MinHashEncoder", None, 5).getStages()
    statistics = FoldStatistics(folds, roles, N, stages)
    assert list(statistics.models) == [0]  # only the target encoder sums the target
    for fold in range(N):
        train = folds.filter(~F.array_contains("test_folds", fold))
        got = {r["id"]: r["w"] for r in statistics.weighted(train, fold, "w").select("id", "w").collect()}
        want = {r["id"]: r["w"] for r in balanced_weights(train, "b", "w").select("id", "w").collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[i], want[i]) for i in want)
        assert statistics.fitted(stages, fold)[0].meta["width"] == 1 and statistics.fitted(stages, fold)[1:] == stages[1:]
