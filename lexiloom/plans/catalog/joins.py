"""Joins, membership, set operations and encode-once-join-back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions.arrays import sparse_cells
from lexiloom.functions.text import squeeze
from lexiloom.operators import counts, prep
from lexiloom.operators.grams import Terms, fitted_vocabulary
from lexiloom.operators.topics import term_rows
from lexiloom.plans.catalog.common import grams_sql, rounded, table


def left_join_suffix(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.col("o_totalprice").alias("amount"))
    customers = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("key"), "c_name", F.col("c_acctbal").alias("amount"))
    return prep.left_join_suffix(orders, customers, "key", "_cas", "_model")


def left_join_required(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("size"))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), F.nullif("p_type", F.lit("PROMO")).alias("make"), F.col("p_size").alias("size"))
    return prep.join_required(items, parts, "key", "make", "_cas", "_model")


def encode_back(spark, sf_dir):
    """A code computed once per distinct string and gathered back to the rows."""
    part = table(spark, sf_dir, "part")
    coded = counts.distinct_keys(part, "p_name").select(
        F.col("key").alias("p_name"), F.md5(squeeze(F.col("key"))).alias("code"))
    return part.select("p_partkey", "p_name").join(coded, "p_name", "left").select("p_partkey", "code")


def _known(spark, sf_dir):
    """Fitted strings: those of all types but one; incoming: every string."""
    part = table(spark, sf_dir, "part").withColumn("key", F.concat_ws(" ", "p_name", "p_brand"))
    return part.filter("p_type <> 'PROMO'").select("key").distinct(), part.select("p_partkey", "key")


def unseen_keys(spark, sf_dir):
    known, incoming = _known(spark, sf_dir)
    return incoming.select("key").distinct().join(known, "key", "left_anti")


def known_mask(spark, sf_dir):
    known, incoming = _known(spark, sf_dir)
    marked = incoming.join(known.withColumn("known", F.lit(True)), "key", "left")
    return marked.select("p_partkey", F.coalesce("known", F.lit(False)).alias("known"))


def union_dedupe(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_name", "p_type", "p_size")
    return prep.union_dedupe(part.filter("p_size < 30"), part.filter("p_size > 10"))


def hstack_features(spark, sf_dir):
    """Character and word counts of each distinct string side by side."""
    keys = counts.distinct_keys(table(spark, sf_dir, "part"), "p_name")
    chars, n_chars = fitted_vocabulary(keys, "char", 2, 4)
    words, n_words = fitted_vocabulary(keys, "word", 1, 1)
    rows = term_rows(keys, [Terms({"analyzer": "char", "lo": 2, "hi": 4, "width": n_chars}, chars),
                            Terms({"analyzer": "word", "lo": 1, "hi": 1, "width": n_words}, words)])
    return sparse_cells(rows, ["key"]).withColumn("value", rounded("value"))


QUERIES = {f.__name__: f for f in (
    left_join_suffix, left_join_required, encode_back, unseen_keys, known_mask, union_dedupe, hstack_features)}

ORACLES = {
    "left_join_suffix": """
        SELECT o_custkey AS key, o_orderkey, o_totalprice AS amount_cas, c_name, c_acctbal AS amount_model
        FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""",
    "left_join_required": """
        SELECT l_partkey AS key, l_orderkey, l_linenumber, l_quantity AS size_cas, p_type AS make, p_size AS size_model
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> 'PROMO'""",
    "encode_back": r"""
        SELECT p_partkey, md5(trim(regexp_replace(lower(p_name), '\s+', ' ', 'g'))) AS code FROM part""",
    "unseen_keys": """
        SELECT DISTINCT p_name || ' ' || p_brand AS key FROM part
        WHERE p_name || ' ' || p_brand NOT IN (SELECT p_name || ' ' || p_brand FROM part WHERE p_type <> 'PROMO')""",
    "known_mask": """
        SELECT p_partkey, (p_name || ' ' || p_brand) IN (SELECT p_name || ' ' || p_brand FROM part WHERE p_type <> 'PROMO') AS known
        FROM part""",
    "union_dedupe": "SELECT DISTINCT p_name, p_type, p_size FROM part",
    "hstack_features": rf"""
        WITH keys AS (SELECT DISTINCT p_name AS key FROM part),
             g AS ({grams_sql('keys')}),
             w AS (SELECT key, unnest(regexp_extract_all(lower(key), '\b\w\w+\b')) AS term FROM keys),
             gv AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS i FROM (SELECT DISTINCT term FROM g)),
             wv AS (SELECT term, row_number() OVER (ORDER BY term) - 1 + (SELECT count(*) FROM gv) AS i
                    FROM (SELECT DISTINCT term FROM w))
        SELECT key, i AS component, count(*)::DOUBLE AS value FROM g JOIN gv USING (term) GROUP BY 1, 2
        UNION ALL SELECT key, i, count(*)::DOUBLE FROM w JOIN wv USING (term) GROUP BY 1, 2""",
}
