"""Table preparation (projections, filters, predicates, derived columns) and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions.arrays import cells, exploded
from lexiloom.functions.numeric import parse_percent, parse_thousands, safe_ln
from lexiloom.operators import counts, prep
from lexiloom.plans.catalog.common import rounded, table
from lexiloom.plans.features import multi_encoder
from lexiloom.roles import ColumnRoles

ORDER_ROLES = ColumnRoles({"o_orderpriority": "Special", "o_totalprice": "Numerical", "o_custkey": "Delete",
                           "o_orderstatus": "y"}, "multiclass", {"o_orderpriority": "none"})


def select_roles(spark, sf_dir):
    return ORDER_ROLES.select(table(spark, sf_dir, "orders"))


def schema_contract(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    ORDER_ROLES.check(orders)
    tagged = ORDER_ROLES.select(orders)
    roles = F.lit(",".join(f"{f.name}:{f.metadata['role']}" for f in tagged.schema))
    return tagged.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("roles", roles)


def _with_gaps(spark, sf_dir):
    """Orders with one value of two columns treated as missing."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_totalprice")


GAPS_SQL = """(SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority,
                      nullif(o_orderstatus, 'P') AS status, o_totalprice FROM orders)"""


def null_profile(spark, sf_dir):
    out = prep.null_profile(_with_gaps(spark, sf_dir), ["priority", "status", "o_totalprice"], 0.25)
    return out.select("column", rounded("missing_fraction").alias("missing_fraction"), "flagged")


def distinct_profile(spark, sf_dir):
    return prep.distinct_profile(_with_gaps(spark, sf_dir), ["priority", "status"])


def distinct_counts(spark, sf_dir):
    return prep.distinct_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_partkey", "l_quantity"])


def stringify_fill(spark, sf_dir):
    out = prep.stringify_fill(_with_gaps(spark, sf_dir), ["o_orderkey", "priority", "status"])
    return out.select("o_orderkey", "priority", "status")


def normalize_string(spark, sf_dir):
    out = prep.normalize_strings(table(spark, sf_dir, "documents"), ["text", "source"])
    return out.select("doc_id", F.md5("text").alias("text_digest"), "source")


def drop_incomplete(spark, sf_dir):
    return prep.drop_incomplete(_with_gaps(spark, sf_dir), ["priority", "status"]).select("o_orderkey", "priority", "status")


def sample_n(spark, sf_dir):
    return prep.sample_exact(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 1000, 7).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


def sample_n_repeated_ids(spark, sf_dir):
    """An id that many rows share, sampled to the exact number of rows."""
    rows = prep.sample_exact(table(spark, sf_dir, "lineitem"), ["l_orderkey"], 1000, 7)
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("rows"))


def shuffle(spark, sf_dir):
    from lexiloom.operators.ranking import dense_ordinals

    order = prep.keyed_order(["o_orderkey"], 11)
    keyed = table(spark, sf_dir, "orders").select(order.alias("digest"), "o_orderkey")
    return dense_ordinals(keyed, "digest", "place", keep=["o_orderkey"]).select("o_orderkey", "place")


def label_encode(spark, sf_dir):
    out = prep.label_encode(table(spark, sf_dir, "part"), "p_brand")
    return out.select("p_partkey", "p_brand", "label")


def drop_rare_classes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "source", "lang").alias("class"))
    return prep.label_encode(docs, "class", prep.RARE_CLASS).select("doc_id", "class", "label")


def derive_boolean(spark, sf_dir):
    return prep.derive_boolean(table(spark, sf_dir, "orders"), "o_orderstatus", "F", "finished").select("o_orderkey", "finished")


def filter_values(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kept = events.filter(F.col("event_type").isin("click", "purchase") & (F.col("user_id") != 3) & (F.col("value") > 0.5))
    return kept.select("event_id", "event_type", "user_id", "value")


def numeric_transform(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey", F.abs("c_acctbal").alias("magnitude"), rounded(safe_ln(F.abs("c_acctbal"), 1e-10)).alias("log_shifted"),
        rounded(F.when(F.col("c_acctbal") > 0, safe_ln(F.col("c_acctbal")))).alias("log_positive"),
        (F.col("c_nationkey") - 1).cast("bigint").alias("less_one"))


def parse_number(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.format_number("o_totalprice", 2)).alias("price"),
        F.concat(F.round(F.col("o_totalprice") / 10000, 2).cast("decimal(12,2)").cast("string"), F.lit("%")).alias("share"))
    return o.select("o_orderkey", rounded(safe_ln(parse_thousands(F.col("price")))).alias("log_price"),
                    rounded(parse_percent(F.col("share"))).alias("share"))


def clean_names(spark, sf_dir):
    messy = table(spark, sf_dir, "supplier").select(*[F.col(c).alias(f" {c}  ") for c in ("s_suppkey", "s_name", "s_acctbal")])
    return prep.clean_names(messy)


SIZES = {1: "tiny", 2: "tiny", 10: "ten", 50: "largest"}


def recode_dict(spark, sf_dir):
    return prep.recode(table(spark, sf_dir, "part"), "p_size", SIZES, "size_label").select("p_partkey", "size_label")


def composite_key(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        prep.composite_key("l_returnflag", "l_orderkey", "l_linenumber").alias("key"), "l_partkey", "l_suppkey")


def multi_encode_column(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    part = table(spark, sf_dir, "part")
    pipeline = multi_encoder("p_type", ["OneHotEncoder", "BinaryEncoder", "HashingEncoder"], "features")
    encoded = pipeline.fit(part).transform(part)
    long = cells(encoded, ["p_type"], vector_to_array("features"))
    return long.groupBy("p_type", "component").agg(rounded(F.sum("value")).alias("total"))


def category_counts(spark, sf_dir):
    out = counts.category_counts(table(spark, sf_dir, "part"), "p_name")
    return out.select("key", "count", rounded("frequency", 9).alias("frequency"))


def topk_categories(spark, sf_dir):
    return counts.topk_categories(table(spark, sf_dir, "part"), "p_name", 10)


def class_conditional_frequency(spark, sf_dir):
    out = counts.class_conditional_frequency(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return out.select("key", "class", rounded("frequency", 9).alias("frequency"))


def class_balance(spark, sf_dir):
    out = counts.class_balance(table(spark, sf_dir, "events"), "event_type")
    return out.select("class", rounded("share", 9).alias("share"), "is_largest")


def topic_top_words(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    words = exploded(part, [F.col("p_type").alias("topic")], F.split("p_name", " "), "word")
    weights = words.groupBy("topic", "word").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return counts.topic_top_words(weights, 3)


QUERIES = {f.__name__: f for f in (
    select_roles, schema_contract, null_profile, distinct_profile, distinct_counts, stringify_fill, normalize_string,
    drop_incomplete, sample_n, sample_n_repeated_ids, shuffle, label_encode, drop_rare_classes, derive_boolean, filter_values,
    numeric_transform, parse_number, clean_names, recode_dict, composite_key, multi_encode_column, category_counts,
    topk_categories, class_conditional_frequency, class_balance, topic_top_words)}

ORACLES = {
    "select_roles": "SELECT o_orderpriority, o_totalprice, o_orderstatus FROM orders",
    "schema_contract": """
        SELECT o_orderstatus, count(*) AS n, 'o_orderpriority:Special,o_totalprice:Numerical,o_orderstatus:y' AS roles
        FROM orders GROUP BY 1""",
    "null_profile": f"""
        SELECT "column", round(f, 6) + 0.0e0 AS missing_fraction, f > 0.25 AS flagged FROM (
            SELECT 'priority' AS "column", avg((priority IS NULL)::INT::DOUBLE) AS f FROM {GAPS_SQL}
            UNION ALL SELECT 'status', avg((status IS NULL)::INT::DOUBLE) FROM {GAPS_SQL}
            UNION ALL SELECT 'o_totalprice', avg((o_totalprice IS NULL)::INT::DOUBLE) FROM {GAPS_SQL})""",
    "distinct_profile": f"""
        SELECT DISTINCT 'priority' AS "column", priority AS value FROM {GAPS_SQL}
        UNION ALL SELECT DISTINCT 'status', status FROM {GAPS_SQL}""",
    "distinct_counts": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct FROM lineitem"""
        for c in ("l_returnflag", "l_linestatus", "l_partkey", "l_quantity")),
    "stringify_fill": f"""
        SELECT o_orderkey::VARCHAR AS o_orderkey, coalesce(priority, 'nan') AS priority,
               coalesce(status, 'nan') AS status FROM {GAPS_SQL}""",
    "normalize_string": "SELECT doc_id, md5(lower(text)) AS text_digest, lower(source) AS source FROM documents",
    "drop_incomplete": f"""
        SELECT o_orderkey, priority, status FROM {GAPS_SQL} WHERE priority IS NOT NULL AND status IS NOT NULL""",
    "sample_n": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem
        ORDER BY md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|7'),
                 l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000""",
    "sample_n_repeated_ids": """
        SELECT l_orderkey, count(*) AS "rows" FROM (SELECT l_orderkey, row_number() OVER (
            ORDER BY md5(l_orderkey || '|7'), l_orderkey) AS place FROM lineitem) WHERE place <= 1000 GROUP BY 1""",
    "shuffle": "SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '|11')) - 1 AS place FROM orders",
    "label_encode": "SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS label FROM part",
    "drop_rare_classes": """
        WITH d AS (SELECT doc_id, source || '-' || lang AS class FROM documents)
        SELECT doc_id, class, dense_rank() OVER (ORDER BY class) - 1 AS label FROM d
        WHERE class IN (SELECT class FROM d GROUP BY 1 HAVING count(*) > 20)""",
    "derive_boolean": "SELECT o_orderkey, o_orderstatus = 'F' AS finished FROM orders",
    "filter_values": """
        SELECT event_id, event_type, user_id, value FROM events
        WHERE event_type IN ('click', 'purchase') AND user_id <> 3 AND value > 0.5""",
    "numeric_transform": """
        SELECT c_custkey, abs(c_acctbal) AS magnitude, round(ln(abs(c_acctbal) + 1e-10), 6) + 0.0e0 AS log_shifted,
               CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) + 0.0e0 END AS log_positive,
               (c_nationkey - 1)::BIGINT AS less_one FROM customer""",
    "parse_number": """
        SELECT o_orderkey, round(ln(round(o_totalprice, 2)), 6) + 0.0e0 AS log_price,
               round(round(o_totalprice / 10000, 2), 6) + 0.0e0 AS share FROM orders""",
    "clean_names": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "recode_dict": """
        SELECT p_partkey, CASE p_size WHEN 1 THEN 'tiny' WHEN 2 THEN 'tiny' WHEN 10 THEN 'ten' WHEN 50 THEN 'largest'
                          ELSE p_size::VARCHAR END AS size_label FROM part""",
    "composite_key": """
        SELECT l_returnflag || l_orderkey || l_linenumber AS key, l_partkey, l_suppkey FROM lineitem""",
    "multi_encode_column": """
        WITH o AS (SELECT key, row_number() OVER (ORDER BY key) AS i, n,
                          ('0x' || right(md5(key), 1))::BIGINT % 8 AS bucket
                   FROM (SELECT p_type AS key, count(*) AS n FROM part GROUP BY 1)),
             k AS (SELECT count(*) AS k, floor(log2(count(*)))::BIGINT + 1 AS digits FROM o),
             cells AS (
                SELECT o.key, c::BIGINT AS component, n, CASE WHEN c = i - 1 THEN 1 ELSE 0 END AS v
                FROM o, k, unnest(range(0, k.k)) AS r(c)
                UNION ALL
                SELECT o.key, k.k + c, n, (i >> (digits - 1 - c)::INT) % 2
                FROM o, k, unnest(range(0, digits)) AS r(c)
                UNION ALL
                SELECT o.key, k.k + digits + c, n, CASE WHEN c = bucket THEN 1 ELSE 0 END
                FROM o, k, unnest(range(0, 8)) AS r(c))
        SELECT key AS p_type, component, (n * v)::DOUBLE AS total FROM cells""",
    "category_counts": """
        SELECT p_name AS key, count(*) AS count, round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 9) + 0.0e0 AS frequency
        FROM part GROUP BY 1""",
    "topk_categories": "SELECT p_name AS key, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "class_conditional_frequency": """
        SELECT l_returnflag AS key, l_linestatus AS class,
               round(count(*) / (sum(count(*)) OVER (PARTITION BY l_linestatus))::DOUBLE, 9) + 0.0e0 AS frequency
        FROM lineitem GROUP BY 1, 2""",
    "class_balance": """
        SELECT event_type AS class, round(n / (sum(n) OVER ())::DOUBLE, 9) + 0.0e0 AS share, n = max(n) OVER () AS is_largest
        FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""",
    "topic_top_words": """
        WITH w AS (SELECT p_type AS topic, unnest(string_split(p_name, ' ')) AS word FROM part),
             r AS (SELECT topic, word, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, word) AS r
                   FROM w GROUP BY 1, 2)
        SELECT topic, string_agg(word, ', ' ORDER BY r) AS label FROM r WHERE r <= 3 GROUP BY 1""",
}
