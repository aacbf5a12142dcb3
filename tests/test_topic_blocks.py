"""Blocks of rows, carried activations and starting rows over all strings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import topic_blocks, topics
from lexiloom.operators.topic_blocks import RowBlocks, candidates, starting_rows
from lexiloom.operators.topics import GammaPoissonEncoder, blocks_of, term_rows

IO = {"inputCol": "s", "outputCol": "code"}


@pytest.fixture(scope="module")
def names(spark):
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    some = customers.select(F.col("c_name").alias("s")).union(parts.select("p_name"))
    return some.union(spark.createDataFrame([("",), (None,), ("x",), ("x",)], "s string")).cache()


def rows_of(names):
    encoder = GammaPoissonEncoder(nTopics=4, **IO)
    keys = encoder.keys(names)
    meta, tables = encoder.columns(keys)
    return term_rows(keys, blocks_of(meta, tables)), meta


def test_blocks_hold_every_row(names, monkeypatch):
    monkeypatch.setattr(topic_blocks, "BLOCK_ENTRIES", 300)
    rows, _ = rows_of(names)
    blocks = RowBlocks(rows, 3)
    want = sorted((r["count"], tuple(r["features"]["indices"]), tuple(r["features"]["values"])) for r in rows.collect())
    assert sum(blocks.blocks.values()) > 10 and blocks.rows == len(want)
    got = []
    for block in blocks.whole.collect():
        at = 0
        for count, size in zip(block["weights"], block["sizes"]):
            got.append((count, tuple(block["terms"][p] for p in block["places"][at:at + size]), tuple(block["values"][at:at + size])))
            at += size
        assert at <= 300 or len(block["sizes"]) == 1
    assert sorted(got) == want


def dense_fit(v, counts, w, passes, steps, rho):
    """The factorization with activations carried from pass to pass, on dense arrays."""
    k = len(w)
    h = np.tile(np.maximum(1e-10, v.sum(axis=1))[:, None] / k, (1, k))
    a, b = np.full(w.shape, 1e-10), np.full(k, 1e-10)
    for _ in range(passes):
        for _ in range(steps):
            h = h * ((v / np.maximum(h @ w, 1e-300)) @ w.T) / 2 + 0.1 / 2
        a = rho * a + w * ((h * counts[:, None]).T @ (v / np.maximum(h @ w, 1e-300)))
        b = rho * b + (h * counts[:, None]).sum(axis=0)
        w = a / b[:, None]
        size = w.sum(axis=1, keepdims=True)
        w, a = w / size, a / size
    return w


@pytest.mark.parametrize("limit", [topics.BROADCAST_WEIGHTS, 0])
def test_activations_are_carried(names, monkeypatch, limit):
    monkeypatch.setattr(topics, "BROADCAST_WEIGHTS", limit)
    monkeypatch.setattr(topic_blocks, "BLOCK_ENTRIES", 2000)
    rows, meta = rows_of(names)
    rows = sorted(rows.collect(), key=lambda r: (-r["count"], r["key"]))
    v, counts = topics.dense_rows([r["features"] for r in rows], meta["terms"]), np.array([r["count"] for r in rows])
    w = v[:4] + 0.1
    w = w / w.sum(axis=1, keepdims=True)
    # Updates never stop early here: activations are still far from their rows' optimum.
    model = GammaPoissonEncoder(nTopics=4, maxIter=3, eSteps=2, macroBatches=1, r=0.9, tol=0.0, init="frequent", **IO)
    monkeypatch.setattr(GammaPoissonEncoder, "prior", lambda self: {"shape": 1.1, "scale": 1.0, "rescale": True, "eps": 0.0, "e_steps": 2})
    assert np.allclose(model.fit(names).weights(), dense_fit(v, counts, w, 3, 2, 0.9), rtol=1e-8, atol=1e-12)


def cost(v, picks):
    return ((v[:, None, :] - picks[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_starts_come_from_all_rows_and_cost_little_more(names, monkeypatch):
    rows, meta = rows_of(names)
    v = topics.dense_rows([r["features"] for r in rows.collect()], meta["terms"])

    def costs():
        return np.mean([cost(v, topics.dense_rows(starting_rows(RowBlocks(rows, seed=s), 4, s), meta["terms"])) for s in range(4)])

    plain = costs()  # few enough rows for each to be a candidate
    monkeypatch.setattr(topic_blocks, "ALL_ROWS", 1)
    monkeypatch.setattr(topic_blocks, "BLOCK_ENTRIES", 700)
    assert costs() <= 1.5 * plain
    blocks = RowBlocks(rows, seed=3)
    few, weights = candidates(blocks, 4)
    assert 4 < len(few) < blocks.rows and weights.sum() == blocks.rows
    again, same = candidates(RowBlocks(rows.repartition(7), seed=3), 4)
    assert len(again) == len(few) and (weights == same).all()
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(few, again))


def test_every_string_can_start(spark, monkeypatch):
    """One far string among many equal-looking ones is among the candidates."""
    monkeypatch.setattr(topic_blocks, "ALL_ROWS", 1)
    strings = [f"aaaa{i % 10}{i // 10 % 10}{i // 100}" for i in range(400)] + ["qwertyuiop" * 20]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    rows, _ = rows_of(df)
    few, _ = candidates(RowBlocks(rows), 2)
    assert max(len(index) for index, _ in few) > 20


def test_no_rows_and_equal_rows(spark):
    rows, _ = rows_of(spark.createDataFrame([("same",)] * 5, "s string"))
    picks = starting_rows(RowBlocks(rows), 3, 0)
    assert len(picks) == 3 and all((p["indices"] == picks[0]["indices"]).all() for p in picks)
    assert starting_rows(RowBlocks(rows.filter("false")), 3, 0) == []


def test_vocabularies_that_are_not_sent(spark, names, monkeypatch):
    """Terms joined to their strings give the same rows, fits and codes as terms sent to the tasks."""
    from lexiloom.operators import grams

    found = []
    for limit in (grams.LOCAL_TERMS, 50):
        monkeypatch.setattr(grams, "LOCAL_TERMS", limit)
        rows, _ = rows_of(names)
        features = {r["key"]: (r["count"], r["features"]["indices"], r["features"]["values"]) for r in rows.collect()}
        model = GammaPoissonEncoder(nTopics=3, maxIter=1, init="frequent", addWords=True, **IO).fit(names)
        codes = {r["key"]: r["features"] for r in model.encode(names.select(F.coalesce("s", F.lit("nan")).alias("key")).distinct()).collect()}
        found.append((features, model.weights(), codes))
    (f1, w1, c1), (f2, w2, c2) = found
    assert f1 == f2 and np.allclose(w1, w2, rtol=1e-8) and c1.keys() == c2.keys()
    assert all(np.allclose(c1[k], c2[k], rtol=1e-6) for k in c1)
    with pytest.raises(ValueError, match="joined"):
        model.blocks()[0].lookup()


def test_hashed_texts_are_counted_where_they_are_packed(spark, monkeypatch):
    """No step hands all features of a batch of rows to another one; blocks and codes are those of whole features."""
    import pyarrow as pa

    from lexiloom.functions import sparse

    texts = [f"text {i} " + "abc défg " * (i % 7) for i in range(300)] + ["", "x"]
    keys = spark.createDataFrame([(t, 1 + len(t) % 3) for t in texts], "key string, count long")
    encoder = GammaPoissonEncoder(nTopics=3, hashing=True, nFeatures=64, dedupe=False, maxIter=1, **IO)
    meta, tables = encoder.columns(keys, 64)
    terms = blocks_of(meta, tables)
    rows = term_rows(keys, terms)
    held = []
    for blocks in (RowBlocks(rows, 2, 5), topics.row_blocks(keys, rows, terms, 2, 5)):
        found = []
        for block in blocks.whole.collect():
            ends = np.cumsum(block["sizes"])
            for mark, count, size, end in zip(block["marks"], block["weights"], block["sizes"], ends):
                places = block["places"][end - size:end]
                found.append((block["batch"], mark, count, tuple(block["terms"][p] for p in places), tuple(block["values"][end - size:end])))
        held.append(sorted(found))
    assert held[0] == held[1] and len(held[0]) == 302

    monkeypatch.setattr(sparse, "COUNTED_BYTES", 500)
    batch = pa.RecordBatch.from_arrays([pa.array(range(302)), pa.array(range(302)), pa.array(range(302)), pa.array(texts)],
                                       ["batch", "mark", "count", "text"])
    parts = list(topic_blocks._counted([batch], (64, 2, 4)))
    assert len(parts) > 10 and sum(p.num_rows for p in parts) == 302
    monkeypatch.undo()

    df = spark.createDataFrame([(t,) for t in [*texts, None]], "s string")
    model = encoder.fit(df)
    plan = model.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("encode(") == 1 and "count(" not in plan  # one step from texts to codes
    rows = df.select(F.coalesce("s", F.lit("nan")).alias("key"))
    vectors = term_rows(rows, terms)
    want = {r["key"]: r["c"] for r in vectors.select("key", topics.topic_codes(F.col("features"), spark, 3, model.state(), model.step()).alias("c")).collect()}
    got = {r["key"]: r["features"] for r in model.encode(rows).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)
