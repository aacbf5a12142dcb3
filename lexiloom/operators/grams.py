"""Encoders on n-grams and words: counts, hashed counts, tf-idf, min-hash, word vectors."""

from __future__ import annotations

from pyspark.ml.param import TypeConverters
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.arrays import exploded
from lexiloom.functions.murmur import minhash_text
from lexiloom.functions.sparse import gram_vector, term_vector
from lexiloom.functions.text import collapsed, padded, tokens
from lexiloom.operators.base import EncoderEstimator, EncoderModel, param, sparse
from lexiloom.operators.counts import idf_weights
from lexiloom.operators.ranking import dense_ordinals
from lexiloom.session import checkpointed, small


# Largest vocabulary collected and sent to the tasks; beyond it terms are joined.
LOCAL_TERMS = 1_000_000


def digest_counts(named: DataFrame, terms: DataFrame, analyzer: str, lo: int, hi: int) -> DataFrame:
    """(_id, component, value): term counts of (_id, key) by vocabulary index, by a join on the term.

    Every string keeps at least one row; terms outside the vocabulary become null. The exploded rows carry the
    16-byte digest ``_id`` instead of the string, which may be a long text.
    """
    exploded = named.select("_id", F.explode_outer(tokens(F.col("key"), analyzer, lo, hi)).alias("term"))
    counted = exploded.groupBy("_id", "term").agg(F.count("term").cast("double").alias("value"))
    found = counted.join(terms.select("term", F.col("ordinal").alias("component")), "term", "left")
    return found.select("_id", "component", "value")


def digest_of(key: str = "key"):
    return F.unhex(F.md5(key)).alias("_id")


def indexed_counts(keys: DataFrame, terms: DataFrame, analyzer: str, lo: int, hi: int) -> DataFrame:
    """(key, component, value) of :func:`digest_counts`."""
    named = keys.select("key", digest_of())
    return digest_counts(named, terms, analyzer, lo, hi).join(named, "_id").select("key", "component", "value")


class Terms:
    """How strings become term vectors: the analyzer and a vocabulary or hash width."""

    def __init__(self, meta: dict, table: DataFrame | None = None, weights: bool = False):
        self.analyzer, self.lo, self.hi, self.width = meta["analyzer"], meta["lo"], meta["hi"], meta["width"]
        self.table, self.weighted = table, weights
        self._sent = None

    @property
    def local(self) -> bool:
        return self.table is None or self.width <= LOCAL_TERMS

    def lookup(self):
        """The vocabulary (and weights) broadcast once; larger ones than ``local`` allows are joined instead."""
        if not self.local:
            raise ValueError(f"a vocabulary of {self.width} terms is joined to its strings, not sent to the tasks")
        if self.table is not None and self._sent is None:
            rows = self.table.orderBy("ordinal").toArrow()
            weights = rows["idf"].to_numpy() if self.weighted else None
            vocabulary = rows["term"].combine_chunks().cast("string")
            self._sent = self.table.sparkSession.sparkContext.broadcast((vocabulary, weights))
        return self._sent

    def vector(self, text, offset: int = 0):
        if self.table is None and self.analyzer == "char":
            return gram_vector(collapsed(text), self.width, self.lo, self.hi, offset)
        return term_vector(tokens(text, self.analyzer, self.lo, self.hi), self.width, offset, self.lookup())


def fitted_vocabulary(keys: DataFrame, analyzer: str, lo: int, hi: int) -> tuple[DataFrame, int]:
    """(term, ordinal) in sorted order, and its size."""
    terms = exploded(keys, [], F.array_distinct(tokens(F.col("key"), analyzer, lo, hi)), "term")
    table = checkpointed(dense_ordinals(terms.distinct(), "term"))
    return table, table.count()


class TermCountModel(EncoderModel):
    """Sparse counts over a fitted vocabulary, or over hash buckets."""

    weighted = False

    def terms(self) -> Terms:
        if not hasattr(self, "_terms"):
            self._terms = Terms(self.meta, self.tables.get("terms"), self.weighted)
        return self._terms

    def encode(self, keys: DataFrame) -> DataFrame:
        terms = self.terms()
        if terms.local:
            return keys.select("key", terms.vector(F.col("key")).alias("features"))
        return sparse(self.joined(indexed_counts(keys, terms.table, terms.analyzer, terms.lo, terms.hi)))

    def in_place(self, rows: DataFrame) -> DataFrame | None:
        if self.terms().local:
            return rows.withColumn("features", self.terms().vector(F.col("_key")))

    def joined(self, counts: DataFrame) -> DataFrame:
        return counts

    def feature_names(self):
        if "terms" not in self.tables:
            return super().feature_names()
        return [r["term"] for r in self.tables["terms"].orderBy("ordinal").toLocalIterator()]


class TfIdfModel(TermCountModel):
    """tf * idf over the fitted vocabulary, rows of unit length."""

    weighted = True

    def joined(self, counts: DataFrame) -> DataFrame:
        weights = self.tables["terms"].select(F.col("ordinal").alias("component"), "idf")
        raw = counts.join(weights, "component", "left").withColumn("_w", F.col("value") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("key")))
        return raw.select("key", "component", (F.col("_w") / norm).alias("value"))


class TermCountEncoder(EncoderEstimator):
    analyzer = param("analyzer", "'char' or 'word'", TypeConverters.toString)
    ngramMin = param("ngramMin", "smallest n-gram", TypeConverters.toInt)
    ngramMax = param("ngramMax", "largest n-gram", TypeConverters.toInt)
    nFeatures = param("nFeatures", "hash width; 0 fits a vocabulary", TypeConverters.toInt)
    defaults = {"analyzer": "char", "ngramMin": 2, "ngramMax": 4, "nFeatures": 0}

    def _shape(self):
        return self.get("analyzer"), self.get("ngramMin"), self.get("ngramMax")

    def _fit(self, df):
        analyzer, lo, hi = self._shape()
        meta = {"analyzer": analyzer, "lo": lo, "hi": hi}
        if self.get("nFeatures"):
            return self.build(TermCountModel(meta={**meta, "width": self.get("nFeatures")}))
        terms, n = fitted_vocabulary(self.keys(df).select("key"), analyzer, lo, hi)
        return self.build(TermCountModel({"terms": terms}, {**meta, "width": n}))


class TfIdfEncoder(TermCountEncoder):
    def _fit(self, df):
        analyzer, lo, hi = self._shape()
        keys = self.keys(df)
        idf = idf_weights(keys, analyzer, lo, hi)
        weights = checkpointed(dense_ordinals(idf, "term", keep=["idf"]))
        meta = {"analyzer": analyzer, "lo": lo, "hi": hi, "width": weights.count()}
        return self.build(TfIdfModel({"terms": weights}, meta))


class MinHashModel(EncoderModel):
    """Per component the smallest seeded hash of the string's n-grams, in [0, 1]."""

    def encode(self, keys: DataFrame) -> DataFrame:
        return self._signed(keys, "key")

    def _signed(self, df: DataFrame, key: str) -> DataFrame:
        lo, hi = self.meta["lo"], self.meta["hi"]
        spare = [" na "[i:i + n] for n in range(lo, hi + 1) for i in range(5 - n)]
        return df.withColumn("features", minhash_text(padded(F.col(key)), lo, hi, self.width, spare))

    def in_place(self, rows: DataFrame) -> DataFrame:
        return self._signed(rows, "_key")


class MinHashEncoder(EncoderEstimator):
    nComponents = param("nComponents", "number of hash functions", TypeConverters.toInt)
    ngramMin = param("ngramMin", "smallest n-gram", TypeConverters.toInt)
    ngramMax = param("ngramMax", "largest n-gram", TypeConverters.toInt)
    defaults = {"nComponents": 30, "ngramMin": 2, "ngramMax": 4}

    def _fit(self, df):
        if self.get("ngramMin") > 4:
            raise ValueError("the fallback ' na ' has no n-grams that long")
        return self.build(MinHashModel(meta={
            "width": self.get("nComponents"), "lo": self.get("ngramMin"), "hi": self.get("ngramMax")}))


class WordVectorModel(EncoderModel):
    """Mean of the unit vectors of a string's known words; zeros without any."""

    def encode(self, keys: DataFrame) -> DataFrame:
        words = F.filter(F.split(F.regexp_replace("key", "\n", " "), r"[ \t\r\f\x0b\x00]+"), lambda w: w != "")
        exploded = keys.select("key", F.explode_outer(words).alias("word"))
        counted = exploded.groupBy("key", "word").agg(F.count("word").alias("_n"))
        found = counted.join(small(self.tables["vectors"], self.meta["rows"], self.width), "word", "left")
        hits = F.sum(F.when(F.col("unit").isNotNull(), F.col("_n")))
        sums = found.groupBy("key").agg(hits.alias("_hits"), *[
            F.sum(F.col("_n") * F.col("unit")[i]).alias(f"_s{i}") for i in range(self.width)])
        mean = F.array(*[F.coalesce(F.col(f"_s{i}") / F.col("_hits"), F.lit(0.0)) for i in range(self.width)])
        return sums.select("key", mean.alias("features"))


class WordVectorEncoder(EncoderEstimator):
    """Sentence vectors from a (word, vector) table such as a pretrained embedding."""

    def __init__(self, vectors: DataFrame | None = None, **kwargs):
        super().__init__(**kwargs)
        self.vectors = vectors

    def _fit(self, df):
        square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        unit = self.vectors.withColumn("_norm", F.sqrt(square)).filter("_norm > 0").select(
            "word", F.transform("vector", lambda x: x.cast("double") / F.col("_norm")).alias("unit"))
        size = unit.select(F.count(F.lit(1)).alias("rows"), F.max(F.size("unit")).alias("width")).first()
        return self.build(WordVectorModel({"vectors": unit}, size.asDict()))
