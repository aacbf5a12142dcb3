"""Text functions against brute force in plain Python."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import EDGE
from lexiloom.functions.murmur import byte_groups, gram_buckets, murmur3
from lexiloom.functions.sparse import term_vector
from lexiloom.functions.text import char_ngrams, padded_ngram_set, word_tokens

DOCS = "/root/testdata/sf0.001/documents.parquet"


def py_murmur(data: bytes, seed: int) -> int:
    rotl = lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF
    mix = lambda k: (rotl((k * 0xCC9E2D51) & 0xFFFFFFFF, 15) * 0x1B873593) & 0xFFFFFFFF
    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (rotl(h ^ mix(int.from_bytes(data[i:i + 4], "little")), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    if len(data) > whole:
        h ^= mix(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & 0xFFFFFFFF
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & 0xFFFFFFFF
    return h ^ (h >> 16)


def py_grams(s, lo=2, hi=4):
    s = re.sub(r"\s\s+", " ", s.lower())
    return [s[i:i + n] for n in range(lo, hi + 1) for i in range(len(s) - n + 1)]


def py_padded(s, lo=2, hi=4):
    s = " " + " ".join(s.lower().split()) + " "
    return {s[i:i + n] for n in range(lo, hi + 1) for i in range(len(s) - n + 1)}


def py_bucket(gram, n):
    h = py_murmur(gram.encode(), 0)
    return abs(h - (1 << 32) if h >= 1 << 31 else h) % n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=8), st.integers(0, 2**32 - 1))
def test_murmur(strings, seed):
    strings = [s.encode("utf-8", "ignore").decode() for s in strings]
    values = pa.array(strings, pa.string())
    assert murmur3(byte_groups(values), len(strings), seed).tolist() == [py_murmur(s.encode(), seed) for s in strings]


def test_murmur_known_value():
    assert murmur3(byte_groups(pa.array(["ab"])), 1, 42)[0] == 3610054215


def test_murmur_of_a_sliced_array():
    values = pa.array(["zz", "abc", "日本", ""]).slice(1)
    assert murmur3(byte_groups(values), 3, 7).tolist() == [py_murmur(s.encode(), 7) for s in ("abc", "日本", "")]


def test_grams_and_words(spark):
    strings = [s for s in EDGE if s is not None] + ["a b\tc", "x" * 300, "Ünï_cödé 12 3 a_b"]
    df = spark.createDataFrame([(s,) for s in strings], "s string").repartition(3)
    col = F.col("s")
    for row in df.select("s", char_ngrams(col).alias("g"), char_ngrams(col, 1, 1).alias("u"),
                         padded_ngram_set(col).alias("p"), word_tokens(col).alias("w")).collect():
        assert sorted(row["g"]) == sorted(py_grams(row["s"]))
        assert sorted(row["u"]) == sorted(py_grams(row["s"], 1, 1))
        assert sorted(row["p"]) == sorted(py_padded(row["s"]))
        assert row["w"] == re.findall(r"\b\w\w+\b", row["s"].lower())


def test_whole_texts_hashed(spark):
    docs = spark.read.parquet(DOCS)
    rows = docs.select("text", term_vector(char_ngrams(F.col("text")), 4096).alias("v")).limit(25).collect()
    for row in rows:
        expected = Counter(py_bucket(g, 4096) for g in py_grams(row["text"]))
        assert dict(zip(row["v"]["indices"], row["v"]["values"])) == expected


def test_whole_texts_minhash(spark):
    from lexiloom.operators.grams import MinHashEncoder

    docs = spark.read.parquet(DOCS)
    model = MinHashEncoder(nComponents=2, inputCol="text", outputCol="v").fit(docs)
    for row in model.transform(docs).select("text", "v").limit(10).collect():
        grams = py_padded(row["text"])
        expected = [min(py_murmur(g.encode(), d) for g in grams) / (2**32 - 1) for d in range(2)]
        assert row["v"].toArray().tolist() == expected


def test_buckets():
    values = pa.array(["ab", "abc", "日本語"])
    assert gram_buckets(values, 100).tolist() == [py_bucket(g, 100) for g in ("ab", "abc", "日本語")]


def test_unknown_analyzer():
    from lexiloom.functions.text import tokens

    with pytest.raises(ValueError):
        tokens(None, "syllable")
