"""N-grams, words, hashed counts and tf-idf."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions.arrays import exploded, sparse_cells
from lexiloom.functions.sparse import gram_vector
from lexiloom.functions.text import collapsed, padded_ngram_set, word_tokens
from lexiloom.operators import counts
from lexiloom.plans.catalog.common import grams_sql, murmur_sql, padded_grams_sql, rounded, table, texts


def char_ngrams_query(spark, sf_dir):
    """Occurrences of every n-gram over the whole texts, added up in each task before they are dealt by n-gram."""
    docs = texts(spark, sf_dir, "documents")
    return counts.gram_totals(docs, F.col("text"))


def padded_ngram_set_query(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return exploded(customers, ["c_custkey"], padded_ngram_set(F.col("c_name")), "term")


def word_tokens_query(spark, sf_dir):
    talks = texts(spark, sf_dir, "conversations")
    words = exploded(talks, ["conv_id", "turn"], word_tokens(F.col("text")), "word")
    return words.groupBy("conv_id", "turn", "word").agg(F.count(F.lit(1)).alias("count"))


def _names(spark, sf_dir):
    return counts.distinct_keys(table(spark, sf_dir, "part"), "p_name")


def ngram_counts(spark, sf_dir):
    return counts.term_counts(counts.distinct_keys(table(spark, sf_dir, "customer"), "c_name"))


def ngram_presence(spark, sf_dir):
    return counts.term_presence(_names(spark, sf_dir))


def word_vocabulary(spark, sf_dir):
    return counts.vocabulary(counts.term_counts(counts.distinct_texts(table(spark, sf_dir, "documents"), "text"), "word", 1, 1))


def hashed_ngrams(spark, sf_dir):
    keys = counts.distinct_keys(table(spark, sf_dir, "customer"), "c_name")
    return _cells(keys.select("key", gram_vector(collapsed(F.col("key")), 128).alias("features")))


def hashed_ngrams_texts(spark, sf_dir):
    """Hashed n-grams of whole texts; checked against brute force in the tests."""
    docs = texts(spark, sf_dir, "documents")
    vectors = docs.select(F.col("doc_id").alias("key"), gram_vector(collapsed(F.col("text")), 4096).alias("features"))
    return _cells(vectors).groupBy("component").agg(
        F.sum("value").cast("bigint").alias("occurrences"), F.count(F.lit(1)).alias("texts"))


def _cells(vectors):
    return sparse_cells(vectors, ["key"]).withColumn("value", rounded("value"))


def _rounded_tfidf(df):
    return df.select("key", "term", rounded("value").alias("value"))


def ngram_tfidf(spark, sf_dir):
    return _rounded_tfidf(counts.tfidf(_names(spark, sf_dir)))


def word_tfidf(spark, sf_dir):
    return _rounded_tfidf(counts.tfidf(counts.distinct_texts(table(spark, sf_dir, "documents"), "text"), "word", 1, 1))


QUERIES = {
    "char_ngrams": char_ngrams_query, "padded_ngram_set": padded_ngram_set_query, "word_tokens": word_tokens_query,
    **{f.__name__: f for f in (ngram_counts, ngram_presence, word_vocabulary, hashed_ngrams, hashed_ngrams_texts, ngram_tfidf, word_tfidf)}}

# The long texts: characters with their followers, so that no text is walked per n-gram.
LONG_GRAMS = r"""
    WITH t AS (SELECT doc_id, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS i
               FROM (SELECT doc_id, regexp_replace(lower(text), '\s\s+', ' ', 'g') AS s FROM documents)),
         f AS (SELECT c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3
               FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT term, count(*) AS count FROM (
        SELECT c || c1 AS term FROM f UNION ALL SELECT c || c1 || c2 FROM f UNION ALL SELECT c || c1 || c2 || c3 FROM f)
    WHERE term IS NOT NULL GROUP BY 1"""

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}_]{{2,}}')"


def _tfidf_sql(source: str, terms: str, key: str = "key") -> str:
    return f"""
        WITH keys AS ({source}), g AS ({terms}),
             tf AS (SELECT key, term, count(*) AS tf FROM g GROUP BY 1, 2),
             idf AS (SELECT term, ln((SELECT sum(n) FROM keys)::DOUBLE / sum(n)::DOUBLE) + 1 AS idf
                     FROM tf JOIN keys USING (key) GROUP BY 1),
             w AS (SELECT key, term, tf * idf AS w FROM tf JOIN idf USING (term))
        SELECT {key} AS key, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY w.key)), 6) + 0.0e0 AS value FROM w"""


ORACLES = {
    "char_ngrams": LONG_GRAMS,
    "padded_ngram_set": f"""
        WITH keys AS (SELECT DISTINCT c_name AS key FROM customer), g AS ({padded_grams_sql('keys')})
        SELECT c_custkey, term FROM customer JOIN g ON c_name = key""",
    "word_tokens": f"""
        SELECT conv_id, turn, word, count(*) AS count
        FROM (SELECT conv_id, turn, unnest({WORDS.format('text')}) AS word FROM conversations) GROUP BY 1, 2, 3""",
    "ngram_counts": f"""
        WITH keys AS (SELECT DISTINCT c_name AS key FROM customer), g AS ({grams_sql('keys')})
        SELECT key, term, count(*) AS count FROM g GROUP BY 1, 2""",
    "ngram_presence": f"""
        WITH keys AS (SELECT DISTINCT p_name AS key FROM part), g AS ({grams_sql('keys')})
        SELECT DISTINCT key, term FROM g""",
    "word_vocabulary": f"""
        WITH g AS (SELECT key, unnest({WORDS.format('key')}) AS term FROM (SELECT DISTINCT text AS key FROM documents))
        SELECT term, count(*) AS count, count(DISTINCT key) AS df FROM g GROUP BY 1""",
    "hashed_ngrams": f"""
        WITH keys AS (SELECT DISTINCT c_name AS key FROM customer), g AS ({grams_sql('keys')}),
             {murmur_sql('g', '(SELECT 0 AS seed)')}
        SELECT key, (CASE WHEN h >= 2147483648 THEN 4294967296 - h::BIGINT ELSE h::BIGINT END) % 128 AS component,
               count(*)::DOUBLE AS value
        FROM g JOIN hashed USING (term) GROUP BY 1, 2""",
    "ngram_tfidf": _tfidf_sql("SELECT p_name AS key, count(*) AS n FROM part GROUP BY 1", grams_sql("keys")),
    "word_tfidf": _tfidf_sql("SELECT text AS key, count(*) AS n FROM documents GROUP BY 1",
                             f"SELECT key, unnest({WORDS.format('key')}) AS term FROM keys", "md5(key)"),
}
