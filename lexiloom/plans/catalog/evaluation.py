"""Splits, metrics, scaling and class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import metrics, models, splits
from lexiloom.plans.catalog.common import rounded, table

FOLDS, TEST, SEED = 3, 1 / 3, 5


def shuffle_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return splits.shuffle_split(orders, ["o_orderkey"], FOLDS, TEST, SEED).select(
        "o_orderkey", F.col("fold").cast("bigint").alias("fold"), "is_test")


def stratified_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return splits.stratified_split(orders, ["o_orderkey"], "o_orderstatus", FOLDS, TEST, SEED).select(
        "o_orderkey", "o_orderstatus", F.col("fold").cast("bigint").alias("fold"), "is_test")


def rare_category_split(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return splits.rare_category_split(part, "p_name", FOLDS, TEST, SEED).select(
        "p_partkey", "p_name", F.col("fold").cast("bigint").alias("fold"), "is_test")


def r2(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("guess", F.col("l_quantity") * 1500)
    return metrics.r2(items, "l_extendedprice", "guess").select(rounded("r2").alias("r2"))


def average_precision(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_extendedprice")
    return metrics.average_precision(items, "y", "l_extendedprice").select(rounded("average_precision", 9).alias("average_precision"))


def average_precision_ties(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_quantity")
    return metrics.average_precision(items, "y", "l_quantity").select(rounded("average_precision", 9).alias("average_precision"))


def accuracy(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("guess", F.when(F.col("l_discount") > 0.05, "R").otherwise("A"))
    return metrics.accuracy(items, "l_returnflag", "guess").select(rounded("accuracy", 9).alias("accuracy"))


def scale(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", F.lit(2.0).alias("constant"))
    out = models.scale_columns(items, ["l_quantity", "l_extendedprice", "constant"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", rounded("l_quantity").alias("l_quantity"),
                      rounded("l_extendedprice").alias("l_extendedprice"), "constant")


def balanced_weights(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return models.balanced_weights(orders, "o_orderpriority").select(
        "o_orderkey", "o_orderpriority", rounded("weight").alias("weight"))


QUERIES = {f.__name__: f for f in (
    shuffle_split, stratified_split, rare_category_split, r2, average_precision, average_precision_ties, accuracy,
    scale, balanced_weights)}

_FOLDS = f"(SELECT unnest(range(0, {FOLDS})) AS fold)"


def _precision_sql(score: str) -> str:
    return f"""
        WITH p AS (SELECT {score} AS s, sum((l_returnflag = 'R')::INT)::DOUBLE AS hits, count(*)::DOUBLE AS n
                   FROM lineitem GROUP BY 1),
             c AS (SELECT hits, sum(hits) OVER (ORDER BY s DESC) / sum(n) OVER (ORDER BY s DESC) AS precision FROM p)
        SELECT round(sum(hits * precision) / sum(hits), 9) + 0.0e0 AS average_precision FROM c"""


ORACLES = {
    "shuffle_split": f"""
        SELECT o_orderkey, fold, row_number() OVER (PARTITION BY fold ORDER BY md5(o_orderkey || '|' || fold || '|{SEED}'))
               <= ceil((SELECT count(*) FROM orders) * (1e0 / 3)) AS is_test
        FROM orders, {_FOLDS}""",
    "stratified_split": f"""
        SELECT o_orderkey, o_orderstatus, fold,
               row_number() OVER (PARTITION BY fold, o_orderstatus ORDER BY md5(o_orderkey || '|' || fold || '|{SEED}'))
               <= round(count(*) OVER (PARTITION BY fold, o_orderstatus) * (1e0 / 3)) AS is_test
        FROM orders, {_FOLDS}""",
    "rare_category_split": f"""
        WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1),
             t AS (SELECT p_name, fold,
                          sum(n) OVER (PARTITION BY fold ORDER BY n, md5(p_name || '|' || fold || '|{SEED}') ROWS UNBOUNDED PRECEDING)
                          <= floor((SELECT count(*) FROM part) * (1e0 / 3)) AS is_test
                   FROM c, {_FOLDS})
        SELECT p_partkey, p_name, fold, is_test FROM part JOIN t USING (p_name)""",
    "r2": """
        SELECT round(1 - sum((l_extendedprice - l_quantity * 1500) ** 2)
                     / sum((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) ** 2), 6) + 0.0e0 AS r2
        FROM lineitem""",
    "average_precision": _precision_sql("l_extendedprice"),
    "average_precision_ties": _precision_sql("l_quantity"),
    "accuracy": """
        SELECT round(avg((l_returnflag = CASE WHEN l_discount > 0.05 THEN 'R' ELSE 'A' END)::INT::DOUBLE), 9) + 0.0e0 AS accuracy
        FROM lineitem""",
    "scale": """
        SELECT l_orderkey, l_linenumber, l_partkey,
               round(l_quantity / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) + 0.0e0 AS l_quantity,
               round(l_extendedprice / (SELECT stddev_pop(l_extendedprice) FROM lineitem), 6) + 0.0e0 AS l_extendedprice,
               2e0 AS constant
        FROM lineitem""",
    "balanced_weights": """
        SELECT o_orderkey, o_orderpriority,
               round((SELECT count(*) / count(DISTINCT o_orderpriority)::DOUBLE FROM orders)
                     / count(*) OVER (PARTITION BY o_orderpriority), 6) + 0.0e0 AS weight
        FROM orders""",
}
