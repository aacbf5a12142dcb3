"""Ridge from sums by fold against refits on the folds' rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from lexiloom.operators import ridge
from lexiloom.operators.models import build_estimator
from lexiloom.operators.ridge import RidgeCV


def points(spark, x, y, fold):
    rows = [(list(map(float, a)), float(b), int(c)) for a, b, c in zip(x, y, fold)]
    return spark.createDataFrame(rows, "x array<double>, label double, fold int").withColumn("features", array_to_vector("x"))


def refit(x, y, penalty):
    mean, level = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - mean).T @ (x - mean) + penalty * np.eye(x.shape[1]), (x - mean).T @ (y - level))
    return w, level - mean @ w


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 6)) @ rng.normal(size=(6, 6)) + 3
    y = x @ rng.normal(size=6) + rng.normal(scale=2.0, size=90) - 7
    return x, y, rng.integers(0, 3, 90)


def test_folds_are_totals_less_their_part(spark, sample):
    x, y, fold = sample
    df = points(spark, x, y, fold).repartition(5)
    model = RidgeCV(foldCol="fold", penalties=[0.1, 5.0, 300.0]).fit(df)
    want = []
    for penalty in (0.1, 5.0, 300.0):
        by_fold = []
        for f in range(3):
            w, b = refit(x[fold != f], y[fold != f], penalty)
            test = y[fold == f]
            by_fold.append(1 - ((test - x[fold == f] @ w - b) ** 2).sum() / ((test - test.mean()) ** 2).sum())
        want.append(np.mean(by_fold))
    assert np.allclose(model.scores, want) and model.penalty == (0.1, 5.0, 300.0)[int(np.argmax(want))]
    w, b = refit(x, y, model.penalty)
    assert np.allclose(model.coefficients, w) and np.isclose(model.intercept, b)
    got = {r["label"]: r["prediction"] for r in model.transform(df).collect()}
    assert all(np.isclose(got[t], p) for t, p in zip(y, x @ w + b))


def test_rows_are_read_once_and_partitions_change_nothing(spark, sample):
    df = points(spark, *sample)
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    seen = df.select("x", "label").mapInArrow(counted, "x array<double>, label double").withColumn("features", array_to_vector("x"))
    one = RidgeCV(seed=1).fit(seen)
    assert calls.value <= 90 + 90  # one look for the width at most, one for the sums
    many = RidgeCV(seed=1).fit(df.repartition(7))
    assert np.allclose(one.coefficients, many.coefficients) and one.penalty == many.penalty


def test_wide_features_have_the_same_objective(spark, sample, monkeypatch):
    df = points(spark, *sample)
    near = RidgeCV(penalties=[20.0]).fit(df)
    monkeypatch.setattr(ridge, "GRAM_WIDTH", 2)
    far = RidgeCV(penalties=[20.0]).fit(df)
    assert np.allclose(near.coefficients, far.coefficients.toArray(), atol=1e-4) and np.isclose(near.intercept, far.intercept, atol=1e-3)


def test_odd_tables(spark):
    same = points(spark, np.ones((6, 2)), np.full(6, 4.0), range(6))
    model = RidgeCV().fit(same)
    assert np.allclose(model.coefficients, 0) and np.isclose(model.intercept, 4) and np.isfinite(model.scores).all()
    assert RidgeCV().fit(same.filter("false")).intercept == 0.0
    assert isinstance(build_estimator("L2RegularizedLinearModel", "regression", "features", "label", 2), RidgeCV)
