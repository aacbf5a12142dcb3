"""Faults found by review: samples of repeated ids, scores, sparse reductions, saved models, network rates."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lexiloom.operators import metrics, models, prep, splits
from lexiloom.operators.reduce import ReducedEncoder
from lexiloom.plans.encoders import column_encoder
from lexiloom.session import scratch_path

WORDS = ["brown tin", "brown steel", "red tin", "red steel", "a", "blue nickel", "blue tin"] * 3 + ["brown tin"] * 4


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)], "id int, s string")


def test_samples_of_repeated_ids_are_exact(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("id"), F.col("id").alias("x"), F.lit("same").alias("c"))
    for n in (0, 1, 10, 33, 100, 200):
        assert prep.sample_exact(df, ["id"], n, 3).count() == min(n, 100)
    twins = df.select("id", "c")
    assert prep.sample_exact(twins, ["id"], 10, 3).count() == 10
    for frame in (df, twins):
        folds = splits.shuffle_split(frame, ["id"], 3, 0.33, 1)
        assert [r["count"] for r in folds.filter("is_test").groupBy("fold").count().collect()] == [33] * 3
        strata = splits.stratified_split(frame, ["id"], "c", 2, 0.25, 1)
        assert [r["count"] for r in strata.filter("is_test").groupBy("fold").count().collect()] == [25] * 2


def test_folds_hold_each_row_once(spark):
    df = spark.range(50)
    rows = splits.shuffle_folds(df, ["id"], 4, 0.3, 1).collect()
    assert len(rows) == 50 and sum(len(r.test_folds) for r in rows) == 4 * 15
    flags = {(r.id, r.fold) for r in splits.shuffle_split(df, ["id"], 4, 0.3, 1).collect() if r.is_test}
    assert flags == {(r.id, f) for r in rows for f in r.test_folds}


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_scores_must_be_numbers(spark, bad):
    df = spark.createDataFrame([(1, 0.5), (0, bad)], "y int, s double")
    with pytest.raises(Exception, match="null or NaN"):
        metrics.average_precision(df, "y", "s").collect()


def dense_rows(model, df):
    return {r.s: np.array(r.v) for r in model.transform(df).select("s", vector_to_array("code").alias("v")).distinct().collect()}


@pytest.mark.parametrize("name", ["OneHotEncoder", "NgramsCountVectorizer"])
def test_pca_of_sparse_codes(words, name):
    full = dense_rows(column_encoder(name, "s", "code").fit(words), words)
    got = dense_rows(column_encoder(name, "s", "code", reduction="PCA", n_components=2).fit(words), words)
    x = np.array([full[w] for w in WORDS])
    centred = x - x.mean(0)
    _, _, v = np.linalg.svd(centred, full_matrices=False)
    want = np.abs(centred @ v[:2].T)
    assert np.allclose(np.abs(np.array([got[w] for w in WORDS])), want, atol=1e-6) or np.allclose(
        (np.array([got[w] for w in WORDS]) ** 2).sum(0), (want ** 2).sum(0), rtol=1e-6)


def test_reduction_keeps_strings_without_a_code(words):
    model = column_encoder("NgramsCountVectorizer", "s", "code", reduction="TruncatedSVD", n_components=2).fit(words)
    keys = words.select(F.col("s").alias("key")).distinct()
    rows = {r.key: r.features for r in model.encode(keys).collect()}
    assert set(rows) == set(WORDS) and rows["a"] == [0.0, 0.0]


@pytest.mark.parametrize("name, reduction", [("OneHotEncoder", "PCA"), ("NgramsCountVectorizer", "TruncatedSVD"),
                                             ("SimilarityEncoder", "GaussianRandomProjection"), ("NgramsLDA", None)])
def test_saved_models_encode_the_same(spark, words, name, reduction):
    model = column_encoder(name, "s", "code", reduction=reduction, n_components=2).fit(words)
    path = scratch_path(spark, "model")
    model.write().save(path)
    loaded = type(model).load(path)
    before, after = dense_rows(model, words), dense_rows(loaded, words)
    assert before.keys() == after.keys() and all(np.allclose(before[k], after[k]) for k in before)


def test_network_rates_differ(spark):
    rng = np.random.default_rng(0)
    rows = [(float(x[0] > 0), x.tolist()) for x in rng.normal(size=(60, 3))]
    df = spark.createDataFrame(rows, "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    grid = models.mlp_grid("multiclass", "features", "label", 3, 2, 0, rates=(0.001, 0.5), shapes=((4,),))
    fitted = [grid.getEstimator().copy(p).fit(df).weights.toArray() for p in grid.getEstimatorParamMaps()]
    assert not np.allclose(fitted[0], fitted[1])


def test_registered_boosting_grows_the_default_trees(spark, monkeypatch):
    from lexiloom.operators import models
    from lexiloom.plans.catalog.models import gradient_boosting

    grown, original = [], models.boosting

    def recorded(*args, **kwargs):
        out = original(*args, **kwargs)
        grown.append(out[1].getMaxIter())
        out[1].setMaxIter(1)
        return out

    monkeypatch.setattr(models, "boosting", recorded)
    assert gradient_boosting(spark, "/root/testdata/sf0.001").count() > 0 and grown == [models.N_TREES]
