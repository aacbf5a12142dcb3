"""Findings of the third round."""

import numpy as np
import pytest

import __spark_entry__ as entry
from compare import difference
from lexiloom.operators.kernels import FisherKernelEncoder, FisherModel, LinearMixtureEncoder, LinearMixtureModel
from lexiloom.operators.reduce import ReducedEncoder

IO = {"inputCol": "s", "outputCol": "code"}
WORDS = ["london", "londres", "lonlon", "paris", "parsi", "paris", "x", "", "roma", None]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "s string")


def test_similarity_holds_every_category(spark, tmp_path):
    import duckdb

    names = ["red tin", "red tan", "blue zinc", "green", "dim ash", "dim ash", "plum", "rose", "sky", "teal", "lace", "puff", "xyz", "a"]
    spark.createDataFrame([(n,) for n in names], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    result = entry.queries()["similarity"](spark, str(tmp_path)).toArrow()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert difference(result, con.sql(entry.oracle_sql()["similarity"]).to_arrow_table()) is None
    top = sorted(sorted(set(names), key=lambda n: (-names.count(n), n))[:10])
    assert result.num_rows == (len(set(names)) - 1) * sum(len(n) > 1 for n in top)
    assert 0.0 in result["value"].to_pylist()


@pytest.mark.parametrize("estimator, model", [
    (FisherKernelEncoder(compare="count", theta="uniform", **IO), FisherModel),
    (FisherKernelEncoder(compare="presence", theta="frequency", **IO), FisherModel),
    (LinearMixtureEncoder(fisher=True, **IO), LinearMixtureModel),
    (LinearMixtureEncoder(fisher=False, **IO), LinearMixtureModel)])
def test_projected_kernels_pair_no_string_with_all_categories(spark, words, monkeypatch, estimator, model):
    """Directions are added up by n-gram; the codes are those of the written kernel."""
    fitted = ReducedEncoder(estimator, "GaussianRandomProjection", 3).fit(words)
    keys = spark.createDataFrame([(w,) for w in ["london", "parisparis", "zzz", "", "rom"]], "key string")
    w = np.array([r["w"] for r in fitted.tables["directions"].orderBy("component").collect()])
    plain = {k: np.zeros(len(w)) for k in [r["key"] for r in keys.collect()]}
    for r in fitted.inner.encode_long(keys).collect():
        plain[r["key"]][r["component"]] = r["value"]
    monkeypatch.setattr(model, "encode", lambda self, keys: pytest.fail("strings are paired with categories"))
    found = {r["key"]: r["features"] for r in fitted.encode(keys).collect()}
    assert set(found) == set(plain)
    for key, code in plain.items():
        np.testing.assert_allclose(found[key], code @ w, atol=1e-9)


GRAM_TEXTS = ["", None, "a", "ab", "abc", "ÉLAN  vital", "日本語 テキスト", "emoji 😀😁x", "line\n\nbreak", "hello world " * 40]


def test_hashed_grams_are_cut_from_bytes(spark, monkeypatch):
    """The same codes as lists of n-grams give, in parts of any size."""
    from pyspark.sql import functions as F

    from lexiloom.functions import murmur
    from lexiloom.functions.sparse import gram_vector, term_vector
    from lexiloom.functions.text import char_ngrams, collapsed, padded, padded_ngram_set

    spare = [" na", "na"]
    rows = spark.createDataFrame([(t,) for t in GRAM_TEXTS], "t string").coalesce(1)
    full = rows.filter("t is not null").select(
        murmur.minhash_signature(padded_ngram_set(F.col("t")), 5, spare).eqNullSafe(murmur.minhash_text(padded(F.col("t")), 2, 4, 5, spare)))
    assert all(r[0] for r in full.collect())
    for width in (16, 100_000):
        same = rows.select(term_vector(char_ngrams(F.col("t")), width).eqNullSafe(gram_vector(collapsed(F.col("t")), width)))
        assert all(r[0] for r in same.collect())
    monkeypatch.setattr(murmur, "TEXT_BYTES", 16)
    import pyarrow as pa

    found = {}
    for first, _, groups in murmur.text_grams(pa.array(GRAM_TEXTS), 2, 4):
        for row, words, size in groups:
            for r, w in zip(row, words):
                found.setdefault(first + int(r), []).append(w.tobytes()[:size].decode())
    for i, text in enumerate(t or "" for t in GRAM_TEXTS):
        assert sorted(found.get(i, [])) == sorted(text[j:j + n] for n in (2, 3, 4) for j in range(len(text) - n + 1))


def test_gram_totals(spark):
    """Every n-gram of every row is counted, rows of equal text too."""
    from collections import Counter

    from pyspark.sql import functions as F

    from lexiloom.operators.counts import gram_totals

    rows = spark.createDataFrame([(t,) for t in [*GRAM_TEXTS, "abc", "日本語"]], "t string").repartition(3)
    texts = [" ".join(t.lower().replace("\n\n", " ").split("  ")) for t in [*GRAM_TEXTS, "abc", "日本語"] if t]
    plain = Counter(t[j:j + n] for t in texts for n in (2, 3, 4) for j in range(len(t) - n + 1))
    assert {r["term"]: r["count"] for r in gram_totals(rows, F.col("t")).collect()} == plain


def test_words_are_added_up_in_their_row(spark):
    """Counting words shuffles nothing, and words of one text only take that text's count as their df."""
    from pyspark.sql import functions as F

    from lexiloom.operators import counts

    rows = [("a", "red red blue", 3), ("b", "blue green", 1), ("c", "", 2), ("d", None, 1), ("e", "x y", 1)]
    keys = spark.createDataFrame(rows, "key string, text string, count long")
    counted = counts.term_counts(keys, "word", 1, 1)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in counted.collect()) == [("a", "blue", 1), ("a", "red", 2), ("b", "blue", 1), ("b", "green", 1)]
    idf = {"red": np.log(8 / 3) + 1, "blue": np.log(8 / 4) + 1, "green": np.log(8 / 1) + 1}
    found = {(r["key"], r["term"]): r["value"] for r in counts.tfidf(keys, "word", 1, 1).collect()}
    plain = {}
    for key, tf in (("a", {"red": 2, "blue": 1}), ("b", {"blue": 1, "green": 1})):
        norm = np.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()))
        plain |= {(key, t): n * idf[t] / norm for t, n in tf.items()}
    assert found.keys() == plain.keys()
    assert all(abs(found[k] - plain[k]) < 1e-12 for k in plain)
