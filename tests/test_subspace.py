"""Leading directions against dense singular value decompositions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import subspace
from lexiloom.operators.grams import TermCountEncoder
from lexiloom.operators.reduce import ReducedEncoder, ReducedModel


def coded(spark, rows, counts, sparse=True):
    """Rows of a dense matrix as (count, features)."""
    if not sparse:
        return spark.createDataFrame([(int(c), [float(x) for x in r]) for r, c in zip(rows, counts)], "count long, features array<double>")
    data = [(int(c), ([int(i) for i in np.flatnonzero(r)], [float(x) for x in r[r != 0]])) for r, c in zip(rows, counts)]
    return spark.createDataFrame(data, "count long, features struct<indices:array<int>,values:array<double>>")


def sample(seed=0, n=120, width=40, rank=8):
    """Sparse rows with clearly different singular values, some empty rows and components, and counts."""
    rng = np.random.default_rng(seed)
    left, right = np.linalg.qr(rng.normal(size=(n, rank)))[0], np.linalg.qr(rng.normal(size=(width, rank)))[0]
    rows = (left * (100 * 0.6 ** np.arange(rank))) @ right.T
    rows[rng.random(rows.shape) < 0.05] = 0
    rows[[3, 50]] = 0
    rows[:, [0, 17]] = 0
    return rows, rng.integers(1, 6, n)


def whole(directions, width, k):
    out = np.zeros((width, k))
    for r in directions.collect():
        out[r["component"]] = r["w"]
    return out


def dense(rows, counts, k, centre):
    if centre:
        rows = rows - np.average(rows, axis=0, weights=counts)
    _, sizes, right = np.linalg.svd(rows * np.sqrt(counts)[:, None], full_matrices=False)
    w = right[:k].T
    return sizes[:k] ** 2, w * np.sign(w[np.abs(w).argmax(axis=0), np.arange(k)])


@pytest.mark.parametrize("sparse", [True, False])
@pytest.mark.parametrize("centre", [False, True])
@pytest.mark.parametrize("narrow", [0, 512])
def test_directions(spark, monkeypatch, sparse, centre, narrow):
    monkeypatch.setattr(subspace, "BLOCK_ENTRIES", 500)  # several blocks a task
    rows, counts = sample()
    df = coded(spark, rows, counts, sparse)
    squares, w = dense(rows, counts, 4, centre)
    found = subspace.leading(df.repartition(3), 40, 4, centre, narrow=narrow, tolerance=0, passes=25)
    assert np.allclose(found.squares, squares, rtol=1e-9)
    assert np.allclose(whole(found.directions, 40, 4), w, atol=1e-6)
    assert np.allclose(found.shift, np.average(rows, axis=0, weights=counts) @ w if centre else 0, atol=1e-6)


def test_partitions_change_nothing(spark):
    rows, counts = sample(1)
    df = coded(spark, rows, counts)
    one, many = (subspace.leading(df.repartition(n), 40, 3, narrow=0, tolerance=0) for n in (1, 40))
    assert np.allclose(whole(one.directions, 40, 3), whole(many.directions, 40, 3), atol=1e-7)


def test_fewer_directions_than_asked_for(spark):
    rows = np.zeros((30, 600))
    rows[:, 5], rows[:10, 7] = 1, 2
    for narrow in (0, 1000):
        found = subspace.leading(coded(spark, rows, np.ones(30)), 600, 5, narrow=narrow)
        w = whole(found.directions, 600, 5)
        assert np.allclose(np.abs(w).sum(axis=0)[2:], 0) and np.allclose((w[:, :2] ** 2).sum(axis=0), 1)
    empty = subspace.leading(coded(spark, rows, np.ones(30)).filter("false"), 600, 5, narrow=0)
    assert empty.directions.count() == 0 and (empty.squares == 0).all()


def test_sparse_products_equal_dense_ones(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 9, 300)
    places = np.concatenate([np.sort(rng.choice(50, s, replace=False)) for s in sizes]).astype(np.int64)
    values, v = rng.normal(size=sizes.sum()), rng.normal(size=(50, 7))
    whole_rows = np.zeros((300, 50))
    whole_rows[np.repeat(np.arange(300), sizes), places] = values
    for fill, at_once in ((1000, 4_000_000), (0, 4_000_000), (1000, 60), (0, 60)):
        monkeypatch.setattr(subspace, "FILL", fill)
        monkeypatch.setattr(subspace, "DENSE_CELLS", at_once)
        assert np.allclose(subspace.product(sizes, places, values, v), whole_rows.T @ (whole_rows @ v))


def test_projections_in_place_and_by_join_agree(spark, monkeypatch):
    from lexiloom.operators import reduce

    strings = spark.createDataFrame([(s,) for s in ["abc", "abd", "", None, "xyz", "abc", "na na", "été"]], "s string")
    for method in ("TruncatedSVD", "PCA", "GaussianRandomProjection"):
        model = ReducedEncoder(TermCountEncoder(inputCol="s", outputCol="code"), method, 3).fit(strings)
        assert isinstance(model, ReducedModel)
        keys = strings.select(F.coalesce("s", F.lit("nan")).alias("key")).distinct()
        near = {r["key"]: r["features"] for r in model.encode(keys).collect()}
        monkeypatch.setattr(reduce, "BROADCAST_CELLS", 1)
        far = {r["key"]: r["features"] for r in model.encode(keys).collect()}
        monkeypatch.undo()
        assert near.keys() == far.keys() and len(near) == 7
        for key in near:
            assert np.allclose(near[key], far[key], atol=1e-9)
        placed = model.in_place(strings.withColumn("_key", F.coalesce("s", F.lit("nan")))).collect()
        assert all(np.allclose(r["features"], near[r["_key"]]) for r in placed) and len(placed) == 8
