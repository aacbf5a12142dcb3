"""Sources and sinks, on files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.counts import category_counts
from lexiloom.plans.catalog.common import rounded, table
from lexiloom.roles import ColumnRoles
from lexiloom.session import scratch_path
from lexiloom.sources import datasets, ledger
from lexiloom.sources.delimited import scan_csv, scan_csv_skip, scan_tagged_files
from lexiloom.sources.derived import materialize

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
NAMES = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _layout(name: str, sep: str, encoding: str, header: bool, by_position: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, name)
        customers = table(spark, sf_dir, "customer").select(*NAMES)
        customers.write.option("sep", sep).option("encoding", encoding).option("header", header).csv(path)
        scanned = scan_csv(spark, path, sep, encoding, header, schema=CUSTOMER, names=None if header or by_position else NAMES)
        return scanned.toDF(*NAMES) if by_position else scanned
    return query


def scan_csv_skip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "preamble")
    lines = table(spark, sf_dir, "supplier").select(
        F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey", "s_acctbal").alias("value"))

    def with_preamble(batches):
        import pyarrow as pa

        head = ["Report", "Prepared for tests", "", "s_suppkey,s_name,s_nationkey,s_acctbal"]
        yield pa.RecordBatch.from_arrays([pa.array(head)], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], names=["value"])

    lines.mapInArrow(with_preamble, "value string").write.text(path)
    return scan_csv_skip(spark, path, 3, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


def scan_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tagged")
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey")
    orders.filter("o_orderstatus = 'F'").write.option("header", True).csv(f"{path}/RSRCH")
    orders.filter("o_orderstatus <> 'F'").write.option("header", True).csv(f"{path}/GNRL")
    return scan_tagged_files(spark, [f"{path}/RSRCH", f"{path}/GNRL"], ["o_orderpriority", "o_custkey"],
                             {"RSRCH": "allowed", "GNRL": "disallowed"},
                             schema="o_orderstatus string, o_orderpriority string, o_custkey bigint")


def materialize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "derived")

    def build() -> DataFrame:
        return category_counts(table(spark, sf_dir, "orders"), "o_orderpriority")

    materialize(spark, path, build)
    again = materialize(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("built twice")))
    return again.select("key", "count", rounded("frequency").alias("frequency"))


def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = ColumnRoles({"o_orderpriority": "Special", "o_totalprice": "Numerical", "o_custkey": "Delete",
                         "o_orderstatus": "y"}, "multiclass")
    datasets.register("order_status", lambda s, root: s.read.parquet(f"{root}/orders.parquet"), roles)
    found = datasets.dataset("order_status")
    return found.roles.select(found.load(spark, sf_dir)).groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("o_totalprice"), 3).alias("mean_price"))


def results_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "results")
    orders = table(spark, sf_dir, "orders")
    per_fold = orders.groupBy("o_orderstatus", (F.pmod("o_orderkey", F.lit(5))).alias("fold")).agg(
        F.count(F.lit(1)).alias("n_train_samples"), F.avg("o_totalprice").alias("score"))
    config = F.to_json(F.struct(F.col("o_orderstatus").alias("dataset")))
    records = per_fold.select(
        F.sha2(config, 256).alias("config_key"), config.alias("config"), "fold", "n_train_samples",
        F.lit(1).cast("bigint").alias("n_train_features"), "score", F.lit(0.0).alias("encoding_time"),
        F.lit(0.0).alias("training_time"))
    ledger.append_results(records, path)
    stored = ledger.read_results(spark, path)
    return stored.select("config_key", "config", "fold", "n_train_samples", rounded("score", 3).alias("score"))


def pending_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = ledger.config_key(F.col("p_brand"), F.col("p_type"))
    planned = part.select("p_brand", "p_type").distinct().withColumn("config_key", key)
    done = part.filter("p_size > 45").select(key.alias("config_key"))
    return ledger.pending(planned, done).select("config_key", "p_brand", "p_type")


QUERIES = {
    "scan_csv_comma": _layout("comma", ",", "UTF-8", True),
    "scan_csv_tab_latin1": _layout("tab", "\t", "ISO-8859-1", True),
    "scan_csv_pipe_headerless": _layout("pipe", "|", "ISO-8859-1", False),
    "scan_csv_semicolon": _layout("semicolon", ";", "UTF-8", True),
    "scan_csv_positions": _layout("positions", "\t", "UTF-8", False, by_position=True),
    "scan_csv_skip": scan_csv_skip_query,
    "scan_tagged_files": scan_tagged,
    "materialize": materialize_query,
    "dataset_registry": dataset_registry,
    "results_sink": results_sink,
    "pending_runs": pending_runs,
}

ORACLES = {
    **{name: CUSTOMER_SQL for name in QUERIES if name.startswith("scan_csv_") and name != "scan_csv_skip"},
    "scan_csv_skip": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
    "scan_tagged_files": """
        SELECT DISTINCT o_orderpriority, o_custkey,
               CASE WHEN o_orderstatus = 'F' THEN 'allowed' ELSE 'disallowed' END AS status FROM orders""",
    "materialize": """
        SELECT o_orderpriority AS key, count(*) AS count,
               round(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 6) + 0.0e0 AS frequency
        FROM orders GROUP BY 1""",
    "dataset_registry": """
        SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 3) + 0.0e0 AS mean_price
        FROM orders GROUP BY 1, 2""",
    "results_sink": """
        SELECT sha256('{"dataset":"' || o_orderstatus || '"}') AS config_key,
               '{"dataset":"' || o_orderstatus || '"}' AS config, o_orderkey % 5 AS fold,
               count(*) AS n_train_samples, round(avg(o_totalprice), 3) + 0.0e0 AS score
        FROM orders GROUP BY o_orderstatus, o_orderkey % 5""",
    "pending_runs": """
        SELECT DISTINCT sha256('{"p_brand":"' || p_brand || '","p_type":"' || p_type || '"}') AS config_key,
               p_brand, p_type
        FROM part WHERE (p_brand, p_type) NOT IN (SELECT (p_brand, p_type) FROM part WHERE p_size > 45)""",
}
