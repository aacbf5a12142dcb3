"""Counts over categories, classes and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import murmur
from lexiloom.functions.arrays import exploded
from lexiloom.functions.sparse import term_totals
from lexiloom.functions.text import collapsed, tokens
from lexiloom.operators import word_blocks
from lexiloom.session import settled


def distinct_keys(df: DataFrame, column: str) -> DataFrame:
    """(key, count): each distinct string once. Map-side aggregation absorbs hot keys."""
    return df.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("count"))


def distinct_texts(df: DataFrame, column: str) -> DataFrame:
    """(key, text, count) with a digest as key, for columns of long texts.

    Rows exploded from a text then carry 32 bytes instead of the text itself.
    """
    return distinct_keys(df, column).select(F.md5("key").alias("key"), F.col("key").alias("text"), "count")


def _text(keys: DataFrame):
    return F.col("text") if "text" in keys.columns else F.col("key")


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """(key, count, frequency)."""
    counts = distinct_keys(df, column)
    total = counts.agg(F.sum("count")).scalar()
    return counts.select("key", "count", (F.col("count") / total).alias("frequency"))


def topk_categories(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return distinct_keys(df, column).orderBy(F.desc("count"), "key").limit(k)


def class_conditional_frequency(df: DataFrame, column: str, target: str) -> DataFrame:
    """(key, class, frequency): share of the class's rows that hold the key."""
    pairs = df.groupBy(F.col(column).alias("key"), F.col(target).alias("class")).agg(
        F.count(F.lit(1)).alias("_n"))
    sizes = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("_size"))
    return pairs.join(sizes, "class").select("key", "class", (F.col("_n") / F.col("_size")).alias("frequency"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """(class, share, is_largest)."""
    sizes = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("_n"))
    total, top = sizes.agg(F.sum("_n")).scalar(), sizes.agg(F.max("_n")).scalar()
    return sizes.select(
        "class", (F.col("_n") / total).alias("share"), (F.col("_n") == top).alias("is_largest"))


def term_counts(keys: DataFrame, analyzer: str = "char", lo: int = 2, hi: int = 4) -> DataFrame:
    """(key, term, count) for distinct keys.

    Words are added up in their row, so that no row of an occurrence is made; grouping n-grams by (key, term) reuses
    the partitioning by key that ``distinct_keys`` left.
    """
    if analyzer == "word":
        pairs = exploded(keys, ["key"], term_totals(tokens(_text(keys), "word", lo, hi)), "_t")
        return pairs.select("key", F.col("_t.term").alias("term"), F.col("_t.count").alias("count"))
    terms = exploded(keys, ["key"], tokens(_text(keys), analyzer, lo, hi), "term")
    return terms.groupBy("key", "term").agg(F.count(F.lit(1)).alias("count"))


def gram_totals(rows: DataFrame, text: Column, lo: int = 2, hi: int = 4) -> DataFrame:
    """(term, count): occurrences of every character n-gram over all rows, whose n-grams never become rows of their own."""
    def add(batches):
        for batch in batches:
            yield from murmur.gram_totals(batch.column(0), lo, hi)

    parts = rows.select(collapsed(text).alias("text")).mapInArrow(add, "term string, count long")
    return parts.groupBy("term").agg(F.sum("count").alias("count"))


def term_presence(keys: DataFrame, analyzer: str = "char", lo: int = 2, hi: int = 4) -> DataFrame:
    """(key, term): which terms occur."""
    return exploded(keys, ["key"], F.array_distinct(tokens(_text(keys), analyzer, lo, hi)), "term")


def vocabulary(counts: DataFrame) -> DataFrame:
    """(term, count, df) over the distinct strings."""
    return counts.groupBy("term").agg(
        F.sum("count").alias("count"), F.count(F.lit(1)).alias("df"))


def tfidf(keys: DataFrame, analyzer: str = "char", lo: int = 2, hi: int = 4,
          weights: DataFrame | None = None) -> DataFrame:
    """(key, term, value) with tf * (ln(n / df) + 1), each key's row L2-normalised.

    ``keys`` holds (key, count): n and df count rows, as a fit on the column does. Pass
    ``weights`` from :func:`idf_weights` to encode other strings with a fitted table.
    Weights small enough to broadcast leave the terms where their key put them; words weighed by their own strings
    never become rows before they are weighed.
    """
    if weights is None and analyzer == "word":
        return word_blocks.own_weights(keys, tokens(_text(keys), "word", lo, hi))
    if weights is None:
        weights = settled(idf_weights(keys, analyzer, lo, hi))
    return _normalised(term_counts(keys, analyzer, lo, hi).join(weights.select("term", "idf"), "term"))


def _normalised(weighted: DataFrame) -> DataFrame:
    weighted = weighted.select("key", "term", (F.col("count") * F.col("idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("key")))
    return weighted.select("key", "term", (F.col("_w") / norm).alias("value"))


def idf_weights(keys: DataFrame, analyzer: str = "char", lo: int = 2, hi: int = 4) -> DataFrame:
    """(term, df, idf) fitted on rows: every distinct string weighs its count."""
    total = keys.agg(F.sum("count")).scalar()
    terms = exploded(keys, ["count"], F.array_distinct(tokens(_text(keys), analyzer, lo, hi)), "term")
    df = terms.groupBy("term").agg(F.sum("count").alias("df"))
    return df.select("term", "df", (F.ln(total / F.col("df")) + 1).alias("idf"))


def topic_top_words(weights: DataFrame, n_top: int = 3) -> DataFrame:
    """(topic, label): the n strongest words of (topic, word, weight).

    A topic is ranked in salted parts first, so only n rows per part meet in the
    final ranking of the topic.
    """
    salted = weights.withColumn("_salt", F.pmod(F.xxhash64("word"), F.lit(64)))
    strongest = [F.desc("weight"), F.asc("word")]
    local = Window.partitionBy("topic", "_salt").orderBy(*strongest)
    final = Window.partitionBy("topic").orderBy(*strongest)
    few = salted.withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= n_top)
    best = few.withColumn("_r", F.row_number().over(final)).filter(F.col("_r") <= n_top)
    listed = best.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("_r", "word"))).alias("_l"))
    return listed.select("topic", F.array_join(F.transform("_l", lambda x: x["word"]), ", ").alias("label"))
