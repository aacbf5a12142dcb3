"""Ranking helpers, splits, metrics, models, folds and the benchmark."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lexiloom.operators import metrics, models, prep, ranking, splits
from lexiloom.roles import ColumnRoles


def test_dense_ordinals(spark):
    df = spark.createDataFrame([(f"k{i % 1000:04d}",) for i in range(1000)], "k string").repartition(7)
    out = ranking.dense_ordinals(df, "k", "o", start=1).collect()
    assert sorted((r["o"], r["k"]) for r in out) == [(i + 1, f"k{i:04d}") for i in range(1000)]


@pytest.mark.parametrize("descending", [True, False])
def test_running_sums(spark, descending):
    rng = np.random.RandomState(0)
    order = rng.permutation(5000).astype(float) ** 2
    values = rng.randint(0, 9, 5000)
    df = spark.createDataFrame(list(zip(order.tolist(), values.tolist())), "o double, v int").repartition(5)
    out = {r["o"]: r["cum_v"] for r in ranking.running_sums(df, "o", ["v"], descending).collect()}
    index = np.argsort(-order if descending else order)
    assert [out[o] for o in order[index]] == np.cumsum(values[index]).tolist()


def test_exact_quota_with_a_hot_group(spark):
    df = spark.range(6000).withColumn("g", F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")))
    out = ranking.flag_lowest(df, ["g"], prep.keyed_order(["id"], 1), ["id"], F.round(F.col("n_group") * 0.25), "f")
    sizes = {r["g"]: r["n"] for r in out.filter("f").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"hot": 1000} and out.count() == 6000


def test_sample_larger_than_table(spark):
    df = spark.range(50)
    assert prep.sample_exact(df, ["id"], 500, 1).count() == 50
    assert prep.sample_exact(df, ["id"], 0, 1).count() == 0
    a, b = (prep.sample_exact(df.repartition(n), ["id"], 10, 3).collect() for n in (1, 6))
    assert sorted(a) == sorted(b) and len(a) == 10


def test_splits(spark):
    df = spark.range(100).withColumn("y", F.col("id") % 3).withColumn("c", F.concat(F.lit("c"), F.floor(F.sqrt("id")).cast("string")))
    shuffled = splits.shuffle_split(df, ["id"], 4, 0.3, 1)
    assert {r["n"] for r in shuffled.filter("is_test").groupBy("fold").agg(F.count("*").alias("n")).collect()} == {30}
    strata = splits.stratified_split(df, ["id"], "y", 2, 0.5, 1).filter("is_test").groupBy("fold", "y").count().collect()
    assert {r["count"] for r in strata} == {17}
    rare = splits.rare_category_split(df, "c", 3, 0.4, 1)
    mixed = rare.groupBy("fold", "c").agg(F.count_distinct("is_test").alias("n")).filter("n > 1").count()
    assert mixed == 0
    assert all(r["n"] <= 40 for r in rare.filter("is_test").groupBy("fold").agg(F.count("*").alias("n")).collect())


def test_average_precision(spark):
    rng = np.random.RandomState(3)
    y, s = rng.randint(0, 2, 400), rng.randint(0, 60, 400) / 7
    df = spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "y int, s double")
    hits, seen, expected = 0, 0, 0.0
    for score in sorted(set(s), reverse=True):
        new = y[s == score].sum()
        hits, seen = hits + new, seen + (s == score).sum()
        expected += new / y.sum() * hits / seen
    assert np.isclose(metrics.average_precision(df, "y", "s").first()[0], expected)


def test_preprocess(spark):
    rows = [(i, None if i % 10 == 0 else f"Name {i % 7}", float(i), "rare" if i < 5 else "many" if i % 2 else "some") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, s string, x double, y string")
    roles = ColumnRoles({"s": "Special", "x": "Numerical", "y": "y"}, "multiclass")
    out = prep.preprocess(df, roles, ["id"])
    assert {r["y"] for r in out.select("y").distinct().collect()} == {0, 1}
    assert out.count() == 195 and out.filter("s = 'nan'").count() == 19
    assert prep.preprocess(df, roles, ["id"], n_rows=120).count() <= 120
    with pytest.warns(UserWarning, match="lacks"):
        prep.warn_missing(df.withColumn("s", F.nullif("s", F.lit("Name 1"))), ["s"])


def test_roles():
    with pytest.raises(ValueError):
        ColumnRoles({"a": "y"}, "ranking")
    with pytest.raises(ValueError):
        ColumnRoles({"a": "Special"}, "binary")


def test_missing_role_column(spark):
    with pytest.raises(ValueError, match="missing"):
        ColumnRoles({"nope": "Special", "id": "y"}, "binary").select(spark.range(3))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.RandomState(0)
    x = rng.randn(120, 3)
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id int, x array<double>, label double")
    return df.withColumn("features", array_to_vector("x")).cache()


def test_scaler(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "x array<double>").withColumn("v", array_to_vector("x"))
    out = models.Scaler("v", "z").fit(df).transform(df).select(vector_to_array("z").alias("z")).collect()
    assert sorted(r["z"] for r in out) == [[1.0, 5.0], [3.0, 5.0]]


@pytest.mark.parametrize("kernel", ["polynomial", "gaussian"])
def test_nystroem_with_all_landmarks_is_the_kernel(points, kernel):
    model = models.Nystroem(inputCol="features", outputCol="z", nComponents=200, kernel=kernel, degree=2, bandwidth=1.0).fit(points)
    rows = model.transform(points).select("x", vector_to_array("z").alias("z")).collect()
    x, z = np.array([r["x"] for r in rows]), np.array([r["z"] for r in rows])
    assert np.allclose(z @ z.T, models._kernel(x, x, model.settings), atol=1e-4)


@pytest.mark.parametrize("task", ["binary", "multiclass", "regression"])
def test_linear_and_boosting(points, task):
    for estimator in (models.build_estimator("L2RegularizedLinearModel", task, "features", "label", 3), models.boosting(task, "features", "label", 0, 3)[0]):
        out = estimator.fit(points).transform(points)
        assert out.select("prediction").count() == 120


def test_factory(points):
    for name in models.CLASSIFIERS:
        assert models.build_estimator(name, "binary", "features", "label", 3) is not None
    with pytest.raises(ValueError, match="unknown task"):
        models.build_estimator("MLP", "ranking", "features", "label", 3)
    with pytest.raises(ValueError, match="no classifier"):
        models.build_estimator("KNN", "binary", "features", "label", 3)
    with pytest.raises(ValueError, match="classification"):
        models.build_estimator("MLP", "regression", "features", "label", 3)


def test_only_the_cut_buckets_are_shuffled(spark):
    """With few groups the table itself meets broadcast joins only."""
    df = spark.range(5000).withColumn("y", F.col("id") % 2)
    out = splits.stratified_split(df, ["id"], "y", 2, 0.5, 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_scores_of_constant_targets(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 1.0, 3.0)], "y int, t double, p double")
    assert metrics.average_precision(df, "y", "p").first()[0] == 0.0
    assert metrics.r2(df, "t", "p").first()[0] == 0.0 and metrics.r2(df, "t", "t").first()[0] == 1.0
