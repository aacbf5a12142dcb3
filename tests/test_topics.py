"""Topic models: objectives, invariants and starting points."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lexiloom.operators import topics
from lexiloom.operators.topics import GammaPoissonEncoder, GammaPoissonModel, MixtureEncoder, NmfEncoder, Rows

IO = {"inputCol": "p_name", "outputCol": "code"}


@pytest.fixture(scope="module")
def part(spark):
    return spark.read.parquet("/root/testdata/sf0.001/part.parquet").cache()


def random_rows(n=30, terms=40, seed=0):
    rng = np.random.RandomState(seed)
    sizes = rng.randint(0, 9, n)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    idx = np.concatenate([rng.choice(terms, s, replace=False) for s in sizes]).astype(np.int64)
    return Rows(rng.randint(1, 5, n).astype(float), starts, sizes, idx, rng.randint(1, 4, sizes.sum()).astype(float))


def state(k=4, terms=40, rescale=True):
    w = np.random.RandomState(1).gamma(1.1, 1.0, (k, terms)) + 0.01
    if rescale:
        w /= w.sum(axis=1, keepdims=True)
    return {"W": w, "shape": 1.1, "scale": 1.0, "rescale": rescale, "eps": 0.0, "e_steps": 5}


def test_activations_lower_the_penalised_objective():
    rows, s = random_rows(), state()

    def objective(h):
        fitted = topics.fitted_counts(rows, h, s["W"])
        kl = (rows.val * np.log(rows.val / fitted) - rows.val).sum() + (s["W"].sum(axis=1) @ h).sum()
        return kl + (h / s["scale"] - (s["shape"] - 1) * np.log(h)).sum()

    values = [objective(topics.poisson_activations(rows, s, i)) for i in range(1, 25)]
    assert all(b <= a + 1e-9 for a, b in zip(values, values[1:]))


@pytest.mark.parametrize("rescale", [True, False])
def test_activations_match_the_row_by_row_rule(rescale):
    rows, s = random_rows(), state(rescale=rescale)
    s["eps"] = 1e-3
    out = topics.poisson_activations(rows, s, 10)
    inner = np.full(4, 2.0) if rescale else s["W"].sum(axis=1) + 1
    first = 0
    for i, size in enumerate(rows.sizes):
        idx, val = rows.idx[first:first + size], rows.val[first:first + size]
        first += size
        h, change = np.full(4, max(1e-10, val.sum()) / 4), 1.0
        for _ in range(10):
            if change <= 1e-6:
                break
            new = h * (s["W"][:, idx] @ (val / (h @ s["W"][:, idx]))) / inner + 0.1 / inner
            change = ((new - h) ** 2).sum() / (h ** 2).sum()
            h = new
        assert np.allclose(out[:, i], h)


def test_chunking_does_not_change_a_pass(spark, part, monkeypatch):
    encoder = GammaPoissonEncoder(nTopics=3, **IO)
    keys = encoder.keys(part)
    meta, tables, rows, w = encoder.begin(part, keys)
    start = np.full(w.shape, topics.TINY)
    one = topics.poisson_pass(rows, {**encoder.prior(), "W": w}, start, start.copy(), 0.9)
    monkeypatch.setattr(topics, "CHUNK_CELLS", 60)
    two = topics.poisson_pass(rows.repartition(5), {**encoder.prior(), "W": w}, start, start.copy(), 0.9)
    assert all(np.allclose(x, y) for x, y in zip(one, two))


@pytest.mark.parametrize("init", ["k-means++", "k-means", "random"])
def test_gamma_poisson(part, init, tmp_path):
    encoder = GammaPoissonEncoder(nTopics=4, maxIter=2, init=init, **IO)
    model = encoder.fit(part)
    assert np.allclose(model.weights().sum(axis=1), 1)
    codes = lambda m: np.array([r[0] for r in m.transform(part).orderBy("p_partkey").select(vector_to_array("code")).collect()])
    first = codes(model)
    assert np.allclose(first, codes(model)) and (first > 0).all()
    assert np.allclose(model.weights(), encoder.fit(part.repartition(7)).weights())
    model.save(str(tmp_path / "m"))
    assert np.allclose(first, codes(GammaPoissonModel.load(str(tmp_path / "m"))))
    assert model.score(part) > 0


def test_more_passes_fit_better(part):
    score = lambda n: GammaPoissonEncoder(nTopics=4, maxIter=n, tol=0.0, r=0.3, **IO).fit(part).score(part)
    assert score(6) < score(1)


def test_labels_and_words(part):
    model = GammaPoissonEncoder(nTopics=3, maxIter=1, addWords=True, **IO).fit(part)
    labels = model.topic_labels(2).collect()
    assert len(labels) == 3 and all(len(r["label"].split(", ")) == 2 for r in labels)


def test_schedule():
    small, large = GammaPoissonEncoder(r=0.3, **IO), GammaPoissonEncoder(rho=0.95, **IO)
    batches, rho = small.schedule(1000)
    assert batches == 2 and np.isclose(rho ** batches, 0.3)
    batches, rho = large.schedule(512 * 80)
    assert batches == 8 and np.isclose(rho ** 8, 0.95 ** 80)


def test_errors(part):
    with pytest.raises(ValueError, match="unknown start"):
        GammaPoissonEncoder(init="other", **IO).fit(part)
    with pytest.raises(ValueError, match="unknown start"):
        MixtureEncoder(init="other", **IO).fit(part)


@pytest.mark.parametrize("init", ["most-frequent-categories", "constant", "random"])
def test_mixture(part, init):
    model = MixtureEncoder(nTopics=4, maxIter=3, init=init, fisher=False, **IO).fit(part)
    assert np.isclose(sum(model.meta["theta"]), 1)
    rows = [r[0] for r in model.transform(part).select(vector_to_array("code")).collect()]
    assert np.allclose(np.array(rows).sum(axis=1), 1)


def test_more_topics_than_strings(spark):
    df = spark.createDataFrame([("ab cd",), ("ab ce",)], "p_name string")
    assert MixtureEncoder(nTopics=5, maxIter=2, **IO).fit(df).width == 2


def test_nmf_error_falls(part):
    def loss(n):
        model = NmfEncoder(nTopics=4, maxIter=n, tol=0.0, eSteps=60, **IO).fit(part)
        keys = NmfEncoder(**IO).keys(part)
        rows = topics.term_rows(keys, model.blocks()).collect()
        codes = {r["key"]: r["features"] for r in model.encode(keys.select("key")).collect()}
        total = 0.0
        for r in rows:
            v = np.zeros(model.meta["terms"])
            v[r["features"]["indices"]] = r["features"]["values"]
            total += r["count"] * ((v - np.array(codes[r["key"]]) @ model.weights()) ** 2).sum()
        return total
    assert loss(8) < loss(1)


@pytest.mark.parametrize("make", [
    lambda: topics.GammaPoissonEncoder(nTopics=3, maxIter=2, inputCol="p_name", outputCol="code"),
    lambda: topics.GammaPoissonEncoder(nTopics=3, maxIter=1, init="random", rescale=False, inputCol="p_name", outputCol="code"),
    lambda: topics.NmfEncoder(nTopics=3, maxIter=2, inputCol="p_name", outputCol="code"),
    lambda: topics.MixtureEncoder(nTopics=3, maxIter=3, inputCol="p_name", outputCol="code"),
    lambda: topics.MixtureEncoder(nTopics=3, maxIter=3, init="random", inputCol="p_name", outputCol="code")])
def test_weights_as_a_table_give_the_same_numbers(spark, monkeypatch, make):
    """Broadcast or joined by term, a fit and its codes agree."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_name")
    keys = part.select(F.col("p_name").alias("key")).distinct()
    found = []
    for limit in (topics.BROADCAST_WEIGHTS, 0):
        monkeypatch.setattr(topics, "BROADCAST_WEIGHTS", limit)
        model = make().fit(part)
        weights = {r.term: r.w for r in model.tables["weights"].collect()}
        codes = {r.key: list(r.features) for r in model.encode(keys).collect()}
        found.append((weights, codes, model.score(part) if hasattr(model, "score") else 0.0))
    (w1, c1, s1), (w2, c2, s2) = found
    assert w1.keys() == w2.keys() and c1.keys() == c2.keys() and np.isclose(s1, s2)
    assert all(np.allclose(w1[t], w2[t], rtol=1e-7) for t in w1)
    assert all(np.allclose(c1[k], c2[k], rtol=1e-6) for k in c1)
