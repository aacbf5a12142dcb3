"""Encoders: golden values, definitions in numpy, properties and errors."""

from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lexiloom.operators.grams import MinHashEncoder, TermCountEncoder, TfIdfEncoder, WordVectorEncoder
from lexiloom.operators.kernels import FisherKernelEncoder, SimilarityEncoder
from lexiloom.operators.lookup import (
    BaseNEncoder, ClassFrequencyEncoder, ContrastEncoder, HashCodeEncoder, LeaveOneOutEncoder, OneHotEncoder,
    PassthroughEncoder, TargetMeanEncoder, leave_one_out_train,
)
from lexiloom.plans import encoders
from test_text import py_grams

IO = {"inputCol": "s", "outputCol": "code"}
WORDS = ["london", "londres", "new london", "paris", "parus", "london", "rome", "roma", "rome", "london"]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(i, w, float(i % 4)) for i, w in enumerate(WORDS)], "id int, s string, y double")


def coded(model, df):
    return {r["id"]: r["a"] for r in model.transform(df).select("id", vector_to_array("code").alias("a")).collect()}


ALL = [
    OneHotEncoder(**IO), OneHotEncoder(dropLast=True, **IO), BaseNEncoder(base=3, **IO), HashCodeEncoder(**IO),
    ContrastEncoder(kind="sum", **IO), ContrastEncoder(kind="polynomial", intercept=True, **IO),
    TargetMeanEncoder(**IO), ClassFrequencyEncoder(**IO), LeaveOneOutEncoder(**IO), TermCountEncoder(**IO),
    TermCountEncoder(nFeatures=32, **IO), TfIdfEncoder(**IO), TfIdfEncoder(analyzer="word", ngramMin=1, ngramMax=1, **IO),
    MinHashEncoder(nComponents=5, **IO), SimilarityEncoder(**IO), FisherKernelEncoder(**IO),
]


@pytest.mark.parametrize("encoder", ALL, ids=lambda e: f"{type(e).__name__}")
def test_edge_strings_and_repartitioning(spark, edge, encoder):
    model = encoder.fit(edge)
    first = coded(model, edge)
    assert len(first) == edge.count()
    assert {len(v) for v in first.values()} == {model.width}
    assert np.isfinite(np.array(list(first.values()))).all()
    again = coded(encoder.fit(edge.repartition(5)), edge.repartition(3))
    assert all(np.allclose(first[i], again[i], atol=1e-9) for i in first)


def test_class_frequency_golden(spark):
    train = spark.createDataFrame(
        list(zip("hola oi bonjour hola oi hola oi oi hola".split(), [1, 1, 1, 1, 1, 0, 0, 0, 0])), "s string, y int")
    test = spark.createDataFrame(list(enumerate("hola bonjour hola oi hello".split())), "id int, s string")
    out = coded(ClassFrequencyEncoder(task="binary", **IO).fit(train), test)
    assert [out[i] for i in range(5)] == [[2 / 4, 2 / 5], [0, 1 / 5], [2 / 4, 2 / 5], [2 / 4, 2 / 5], [0, 0]]
    with pytest.raises(ValueError):
        ClassFrequencyEncoder(task="regression", **IO).fit(train)


def test_unseen_strings(spark, words):
    new = spark.createDataFrame([(0, "zzz"), (1, "rome")], "id int, s string")
    assert coded(OneHotEncoder(**IO).fit(words), new)[0] == [0.0] * 7
    assert coded(BaseNEncoder(**IO).fit(words), new)[0] == [0.0] * 3
    assert coded(TargetMeanEncoder(labelCol="y", **IO).fit(words), new)[0] == [1.3]
    for encoder in (OneHotEncoder, TargetMeanEncoder, BaseNEncoder):
        model = encoder(handleUnknown="error", **IO).fit(words)
        with pytest.raises(Exception, match="not a fitted category: zzz"):
            model.transform(new).collect()


def test_one_hot_sums(words):
    rows = coded(OneHotEncoder(**IO).fit(words), words).values()
    assert all(sum(r) == 1 for r in rows)
    dropped = coded(OneHotEncoder(dropLast=True, **IO).fit(words), words)
    assert sorted({sum(r) for r in dropped.values()}) == [0, 1]


def test_polynomial_contrasts_are_orthonormal(spark):
    df = spark.createDataFrame([(i, f"{i:03d}") for i in range(40)], "id int, s string")
    out = coded(ContrastEncoder(kind="polynomial", **IO).fit(df), df)
    m = np.array([out[i] for i in range(40)])
    assert np.allclose(m.T @ m, np.eye(39), atol=1e-8) and np.allclose(m.sum(axis=0), 0, atol=1e-8)
    assert (np.diff(m[:, 0]) > 0).all()


def test_minhash_of_a_union(spark):
    from lexiloom.functions.murmur import minhash_signature

    df = spark.createDataFrame([(["ab", "bc"], ["cd", "xyz"])], "a array<string>, b array<string>")
    row = df.select(minhash_signature(F.col("a"), 9).alias("a"), minhash_signature(F.col("b"), 9).alias("b"),
                    minhash_signature(F.array_union("a", "b"), 9).alias("u")).first()
    assert row["u"] == [min(x, y) for x, y in zip(row["a"], row["b"])]


def test_minhash_in_place_equals_deduped(edge):
    deduped = coded(MinHashEncoder(nComponents=6, **IO).fit(edge), edge)
    assert deduped == coded(MinHashEncoder(nComponents=6, dedupe=False, **IO).fit(edge), edge)
    assert all(0 <= x <= 1 for v in deduped.values() for x in v)


def test_terms_in_place_equal_deduped_and_joined(edge, monkeypatch):
    from lexiloom.operators import grams

    for encoder in (TermCountEncoder, TfIdfEncoder):
        one = coded(encoder(**IO).fit(edge), edge)
        two = coded(encoder(dedupe=False, **IO).fit(edge), edge)
        monkeypatch.setattr(grams, "LOCAL_TERMS", 0)
        three = coded(encoder(**IO).fit(edge), edge)
        monkeypatch.undo()
        assert all(np.allclose(one[i], two[i]) and np.allclose(one[i], three[i]) for i in one)


def dense_counts(strings, vocabulary):
    return np.array([[Counter(py_grams(s))[t] for t in vocabulary] for s in strings], dtype=float)


@pytest.mark.parametrize("compare", ["count", "presence"])
@pytest.mark.parametrize("theta", ["uniform", "frequency"])
def test_fisher_kernel_definition(words, compare, theta):
    cats = sorted(set(WORDS))
    vocabulary = sorted({g for c in cats for g in py_grams(c)})
    c = dense_counts(cats, vocabulary)
    strings = [*WORDS, "lon"]
    s = dense_counts(strings, vocabulary)
    if compare == "presence":
        c, s = (c > 0).astype(float), (s > 0).astype(float)
    counts = Counter(WORDS)
    mass = np.array([1 / len(cats) if theta == "uniform" else counts[x] / len(WORDS) for x in cats])
    expected = np.zeros((len(strings), len(cats)))
    for i in range(len(strings)):
        same = c == s[i]
        gamma = (same * mass[:, None]).sum(axis=0)
        expected[i] = (same / np.where(gamma > 0, gamma, np.inf)).sum(axis=1)
    more = words.unionByName(words.sparkSession.createDataFrame([(10, "lon", 0.0)], words.schema))
    out = coded(FisherKernelEncoder(compare=compare, theta=theta, **IO).fit(words), more)
    assert np.allclose([out[i] for i in range(len(strings))], expected)


def test_similarity_definition(words, monkeypatch):
    from lexiloom.operators import kernels

    cats = sorted(set(WORDS))
    grams = {w: Counter(py_grams(w)) for w in cats}
    expected = [[sum((grams[w] & grams[c]).values()) / sum((grams[w] | grams[c]).values()) for c in cats] for w in WORDS]
    out = coded(SimilarityEncoder(**IO).fit(words), words)
    assert np.allclose([out[i] for i in range(len(WORDS))], expected)
    monkeypatch.setattr(kernels, "PIVOT_WIDTH", 1)
    wide = coded(SimilarityEncoder(**IO).fit(words), words)
    assert np.allclose([wide[i] for i in range(len(WORDS))], expected)


def test_prototypes(words):
    model = SimilarityEncoder(categories="most_frequent", nPrototypes=2, **IO).fit(words)
    assert model.feature_names() == ["london", "rome"]
    near = SimilarityEncoder(categories="k-means", nPrototypes=3, **IO).fit(words)
    assert 1 <= near.width <= 3 and set(near.feature_names()) <= set(WORDS)
    explicit = SimilarityEncoder(categories=["london", "rome"], **IO).fit(words)
    assert explicit.width == 2
    with pytest.raises(ValueError, match="sorted"):
        SimilarityEncoder(categories=["rome", "london"], **IO).fit(words)
    with pytest.raises(ValueError, match="outside the explicit"):
        SimilarityEncoder(categories=["london"], handleUnknown="error", **IO).fit(words)


def test_leave_one_out(words):
    model = coded(LeaveOneOutEncoder(labelCol="y", **IO).fit(words), words)
    mean = np.mean([i % 4 for i in range(10)])
    assert model[0] == [np.mean([0, 1, 1])] and model[3] == [mean]
    train = {r["id"]: r["v"] for r in leave_one_out_train(words, "s", "y", "v").collect()}
    assert train[0] == 1.0 and train[3] == mean


def test_word_vectors(spark):
    vectors = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 2.0]), ("null", [0.0, 0.0])], "word string, vector array<double>")
    df = spark.createDataFrame([(0, "a b"), (1, "a\na zz"), (2, "zz"), (3, "null b")], "id int, s string")
    out = coded(WordVectorEncoder(vectors=vectors, **IO).fit(df), df)
    assert np.allclose(out[0], [0.3, 0.9]) and np.allclose(out[1], [0.6, 0.8])
    assert out[2] == [0, 0] and out[3] == [0, 1]


def test_passthrough_needs_finite_numbers(spark):
    io = {"inputCol": "x", "outputCol": "code"}
    good = spark.createDataFrame([(1.5,)], "x double")
    assert PassthroughEncoder(**io).fit(good).transform(good).first()["code"].toArray().tolist() == [1.5]
    for bad in (None, float("nan"), float("inf")):
        df = spark.createDataFrame([(bad,)], "x double")
        with pytest.raises(Exception, match="not finite"):
            PassthroughEncoder(**io).fit(df).transform(df).collect()


def test_wrapper_errors():
    with pytest.raises(ValueError, match="no encoder"):
        encoders.column_encoder("Nope", "s", "code")
    with pytest.raises(ValueError, match="handle_unknown"):
        encoders.column_encoder("OneHotEncoder", "s", "code", handle_unknown="maybe")
    with pytest.raises(ValueError, match="sorted"):
        encoders.column_encoder("OneHotEncoder", "s", "code", categories=["b", "a"])
    with pytest.raises(ValueError, match="unknown reduction"):
        encoders.column_encoder("OneHotEncoder", "s", "code", "Isomap", 2)
    with pytest.raises(ValueError, match="k-means"):
        encoders.column_encoder("OneHotEncoder", "s", "code", "k-means", 2)


LABELLED = {"task": "multiclass", "label": "y"}
SLOW = {"NgramsLDA"}


@pytest.mark.parametrize("name", [n for n in encoders.names() if n not in SLOW], ids=str)
def test_every_registered_name(spark, words, name):
    numeric = name in (None, "Passthrough", "Categorical")
    vectors = spark.createDataFrame([("london", [1.0, 0.0]), ("rome", [0.0, 1.0])], "word string, vector array<double>")
    encoder = encoders.column_encoder(name, "id" if numeric else "s", "code", n_components=3, vectors=vectors, **LABELLED)
    out = coded(encoder.fit(words), words)
    assert len(out) == len(WORDS) and np.isfinite(np.array(list(out.values()))).all()


@pytest.mark.parametrize("method", ["TruncatedSVD", "PCA", "GaussianRandomProjection"])
def test_reductions(words, method):
    name = "SimilarityEncoder" if method == "PCA" else "NgramsCountVectorizer"
    out = coded(encoders.column_encoder(name, "s", "code", method, 3).fit(words), words)
    assert {len(v) for v in out.values()} == {3}
    full = coded(encoders.column_encoder(name, "s", "code").fit(words), words)
    x = np.array([full[i] for i in range(10)])
    if method == "GaussianRandomProjection":
        return
    centred = x - x.mean(axis=0) if method == "PCA" else x
    z = np.array([out[i] for i in range(10)])
    singular = np.linalg.svd(centred, compute_uv=False)[:3]
    assert np.allclose(np.linalg.norm(z, axis=0), singular)


def test_reduction_steps_aside(words):
    with pytest.warns(UserWarning, match="no reduction needed|all categories are kept"):
        model = encoders.column_encoder("OneHotEncoder", "s", "code", "TruncatedSVD", 50).fit(words)
    assert model.width == 7


def test_save_and_load(words, tmp_path):
    fitted = Pipeline(stages=[SimilarityEncoder(**IO)]).fit(words)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert coded(loaded, words) == coded(fitted, words)


def test_hot_string(spark):
    """One string in a third of the rows, every other row its own."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("s"),
                                  (F.col("id") % 2).cast("double").alias("y"))
    for encoder in (OneHotEncoder(**IO), TargetMeanEncoder(labelCol="y", **IO), MinHashEncoder(nComponents=2, **IO),
                    TfIdfEncoder(**IO), SimilarityEncoder(categories="most_frequent", nPrototypes=2, **IO)):
        out = encoder.fit(df).transform(df)
        assert out.count() == 3000 and out.filter("code is null").count() == 0
        assert out.filter("s = 'hot'").select(F.count_distinct(F.hash(vector_to_array("code")))).first()[0] == 1


@pytest.mark.parametrize("name", ["NgramNaiveFisherKernel", "AdHocNgramsMultinomialMixture"])
def test_kernels_of_any_width_are_reduced(words, monkeypatch, name):
    """Projections of a kernel that is never written out equal those of one that is."""
    from lexiloom.operators import kernels, reduce

    full = coded(encoders.column_encoder(name, "s", "code").fit(words), words)
    model = encoders.column_encoder(name, "s", "code", "GaussianRandomProjection", 3).fit(words)
    w = np.zeros((7, 3))
    for r in model.tables["directions"].collect():
        w[r["component"]] = r["w"]
    monkeypatch.setattr(kernels, "PIVOT_WIDTH", 1)
    for cells in (reduce.BROADCAST_CELLS, 0):
        monkeypatch.setattr(reduce, "BROADCAST_CELLS", cells)
        out = coded(model, words)
        assert all(np.allclose(out[i], np.array(full[i]) @ w) for i in full)


def test_too_many_categories(words, monkeypatch):
    from lexiloom.operators import kernels, lookup

    monkeypatch.setattr(kernels, "PIVOT_WIDTH", 3)
    with pytest.raises(ValueError, match="prototypes"):
        FisherKernelEncoder(**IO).fit(words).transform(words)
    monkeypatch.setattr(lookup, "MAX_CLASSES", 2)
    with pytest.raises(ValueError, match="classes"):
        ClassFrequencyEncoder(**IO).fit(words)
