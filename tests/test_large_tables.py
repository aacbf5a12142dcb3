"""Steps that were mended for larger tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from lexiloom.operators import counts, subspace, word_blocks

from test_subspace import coded, sample, whole


@pytest.mark.parametrize("tile", [5, 1000])
def test_directions_travel_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(subspace, "BLOCK_ENTRIES", 200)
    monkeypatch.setattr(subspace, "TILE_CELLS", tile * 6)
    rows, counts = sample(2)
    matrix = subspace.packed(coded(spark, rows, counts).repartition(3))
    blocks = subspace.Blocks(matrix, 6, matrix.count())
    scaled = rows * np.sqrt(counts)[:, None]
    v = subspace.random_rows(np.arange(40), 6, 35)
    first = blocks.times_gram(None, 35).cache()
    turned = subspace._turned(first, 6, np.zeros(6), np.eye(6))
    second = blocks.times_gram(turned, 35).cache()
    held = rows.any(axis=0)
    once = scaled.T @ (scaled @ v)
    assert np.allclose(whole(subspace._spread_out(turned, 6), 40, 6), once)
    assert second.filter("tile >= 0").count() == (-(-40 // tile) if tile < 40 else 1)
    twice = subspace._spread_out(second.filter("tile >= 0"), 6)
    assert np.allclose(whole(twice, 40, 6), scaled.T @ (scaled @ once))
    assert np.allclose([r["mass"] for r in twice.orderBy("component").collect()], (rows * counts[:, None]).sum(axis=0)[held])
    beside = subspace._beside(second, 6)
    assert np.allclose(beside[:6], once.T @ scaled.T @ scaled @ once)
    assert np.allclose(beside[6], (rows * counts[:, None]).sum(axis=0) @ once)
    blocks.close()


def test_blocks_meet_their_directions_in_groups(spark):
    """Components that blocks have in common travel once for a group of them, and entries take few bytes."""
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 300, (400, 40)) * (rng.random((400, 40)) < 0.7)
    matrix = subspace.packed(coded(spark, rows, rng.integers(1, 4, 400)).repartition(40)).cache()
    n = matrix.count()
    blocks = subspace.Blocks(matrix, 6, n, 40)
    groups = blocks.wanted.select("group").distinct().count()
    assert n == 40 and groups <= spark.sparkContext.defaultParallelism < n
    blocks.close()
    (one,) = subspace.packed(coded(spark, rows, np.ones(400)).coalesce(1)).collect()
    assert one["whole"] and len(one["steps"]) + len(one["values"]) < 4 * one["entries"]


@pytest.mark.parametrize("values", ["whole", "fractions", "negative", "large"])
def test_entries_come_back_as_they_were(spark, monkeypatch, values):
    monkeypatch.setattr(subspace, "PART_ENTRIES", 50)
    rows, counts = sample(5)
    rows = {"whole": np.rint(np.abs(rows)), "fractions": rows, "negative": np.rint(rows), "large": np.rint(np.abs(rows)) * 100_000}[values]
    table = subspace.packed(coded(spark, rows, counts).coalesce(1)).toArrow().combine_chunks()
    out = np.zeros((len(rows), 40))
    (block,) = subspace._blocks_of(table)
    for span, sizes, places, found in subspace._parts_of(block):
        own = np.repeat(np.arange(span.start, span.stop), sizes)
        out[own, block["terms"][places]] = found
    order = np.lexsort(out.T)
    want = rows * np.sqrt(counts)[:, None]
    assert (out[order] == want[np.lexsort(want.T)]).all()


def test_codes_are_not_joined_to_their_counts(spark, monkeypatch):
    """Codes of texts are far larger than the texts, and a join sorted them."""
    from lexiloom.operators import reduce
    from lexiloom.operators.grams import TermCountEncoder

    plans, fit = [], reduce.svd_directions
    monkeypatch.setattr(reduce, "svd_directions", lambda weighted, *a: plans.append(
        (weighted._jdf.queryExecution().optimizedPlan().toString(), weighted.count())) or fit(weighted, *a))
    df = spark.createDataFrame([(f"name {i % 20} of {i % 7}",) for i in range(200)] + [(None,)], "s string")
    reduce.ReducedEncoder(TermCountEncoder(inputCol="s", outputCol="code"), "TruncatedSVD", 3).fit(df)
    assert plans[0][1] == 141 and "Join" not in plans[0][0]


def test_blocks_end_by_components(spark, monkeypatch):
    monkeypatch.setattr(subspace, "BLOCK_TERMS", 10)
    monkeypatch.setattr(subspace, "BLOCK_ENTRIES", 400)
    rows = np.eye(100)
    found = subspace.packed(coded(spark, rows, np.ones(100)).coalesce(1)).collect()
    assert sum(len(r["sizes"]) // 4 for r in found) == 100 and max(len(r["terms"]) // 8 for r in found) <= 60


@pytest.mark.parametrize("sparse", [True, False])
def test_codes_times_directions_by_block(spark, monkeypatch, sparse):
    """As the join of cells gives them; strings without entries, tiles without directions and null strings as well."""
    monkeypatch.setattr(subspace, "BLOCK_ENTRIES", 300)
    monkeypatch.setattr(subspace, "TILE_CELLS", 12)
    rows, _ = sample(3)
    cells = lambda r: ([int(i) for i in np.flatnonzero(r)], [float(x) for x in r[r != 0]]) if sparse else [float(x) for x in r]
    kind = "struct<indices:array<int>,values:array<double>>" if sparse else "array<double>"
    codes = spark.createDataFrame([(str(i) if i else None, cells(r)) for i, r in enumerate(rows)], f"key string, features {kind}")
    w = np.random.default_rng(1).normal(size=(40, 3))
    kept = [i for i in range(40) if i % 5 and i not in (8, 9, 11, 12)]
    directions = spark.createDataFrame([(i, w[i].tolist()) for i in kept], "component long, w array<double>")
    w[[i for i in range(40) if i not in kept]] = 0
    found = {r["key"]: r["features"] for r in subspace.multiplied(codes, directions, 3).collect()}
    assert len(found) == len(rows)
    for i, row in enumerate(rows):
        assert np.allclose(found[str(i) if i else None], row @ w)


@pytest.mark.parametrize("entries, together", [(1 << 20, 1 << 19), (7, 3)])
def test_words_are_weighed_in_blocks(spark, monkeypatch, entries, together):
    """No row of a word is shuffled or sorted by its string, and blocks of any size give the same weights."""
    monkeypatch.setattr(word_blocks, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(word_blocks, "WORDS_PER_TASK", together)
    texts = [None, "", "a b", "one two two", "ONE two three three", "one", "one", "été 日本語 x_1 été", "again again"] + [
        " ".join(f"word{i * j % 23}" for j in range(i % 9)) for i in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    for keys in (counts.distinct_texts(rows, "text"), counts.distinct_keys(rows, "text")):
        found = counts.tfidf(keys, "word", 1, 1)
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
        got = {(r["key"], r["term"]): r["value"] for r in found.collect()}
        want = {}
        words = {t: Counter(re.findall(r"\b\w\w+\b", (t or "").lower())) for t in set(texts)}
        df = Counter(w for t in texts for w in words[t])
        for text, own in words.items():
            weights = {w: n * (np.log(len(texts) / df[w]) + 1) for w, n in own.items()}
            size = np.sqrt(sum(x * x for x in weights.values()))
            name = hashlib.md5(text.encode()).hexdigest() if text is not None and "text" in keys.columns else text
            want |= {(name, w): x / size for w, x in weights.items()}
        assert got.keys() == want.keys() and len(want) > 150
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert counts.tfidf(counts.distinct_texts(rows.filter("false"), "text"), "word", 1, 1).count() == 0


def test_lda_passes_over_bounded_partitions(spark, monkeypatch):
    """A pass of the fit reads cached rows; one file's rows were one partition whatever their number."""
    from pyspark.ml.clustering import LDA

    from lexiloom import session
    from lexiloom.operators.topics import LdaEncoder

    seen, fit = [], LDA.fit
    monkeypatch.setattr(LDA, "fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), df.count())) or fit(self, df))
    names = spark.createDataFrame([(f"part {i % 7}",) for i in range(600)], "name string").coalesce(1)
    LdaEncoder(inputCol="name", outputCol="code", nTopics=2, maxIter=1).fit(names)
    monkeypatch.setattr(session, "PORTION", 20_000)
    LdaEncoder(inputCol="name", outputCol="code", nTopics=2, maxIter=1).fit(names)
    assert seen[0] == (1, 600)
    assert seen[1][0] >= 10 and seen[1][1] == 600


def test_tuned_models_compute_features_once(spark):
    """A search over penalties computed its rows' features again for every fold's parts and for the last fit."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from lexiloom.operators.models import linear_model

    rows = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def features(i):
        rows.add(1)
        return [float(i % 7), float(i % 3)]

    points = spark.range(0, 60, 1, 2).select(array_to_vector(features("id")).alias("features"), (F.col("id") % 2).cast("double").alias("label"))
    linear_model("binary", "features", "label", None, 0).fit(points)
    assert rows.value <= 120
