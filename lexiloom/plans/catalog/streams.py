"""Encoders on streams read from the given files."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lexiloom.functions.arrays import cells
from lexiloom.operators.grams import MinHashEncoder
from lexiloom.operators.lookup import TargetMeanEncoder
from lexiloom.operators.topics import GammaPoissonEncoder
from lexiloom.plans.catalog.common import codes_of, rounded, table
from lexiloom.plans.catalog.encoders import TARGET_SQL, _minhash_sql, columns
from lexiloom.session import scratch_path
from lexiloom.streaming import encode_stream
from lexiloom.streaming.topics import IncrementalTopics


def stream_of(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(spark, stream, name):
    """Write a stream until its source is used up and read the result back."""
    path = scratch_path(spark, name)
    query = (stream.writeStream.format("parquet").option("path", f"{path}/out")
             .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def minhash_stream(spark, sf_dir):
    model = MinHashEncoder(nComponents=10, **columns("c_name")).fit(table(spark, sf_dir, "customer"))
    coded = encode_stream(model, stream_of(spark, sf_dir, "customer"))
    out = cells(coded, ["c_custkey"], vector_to_array("code")).withColumn("value", rounded("value", 9))
    return drained(spark, out, "minhash")


def unseen_category_policy(spark, sf_dir):
    """Codes fitted on all types but one; strings new in the stream take the overall mean."""
    known = table(spark, sf_dir, "part").filter("p_type <> 'PROMO'").withColumn("key", F.concat_ws(" ", "p_name", "p_brand"))
    model = TargetMeanEncoder(labelCol="p_retailprice", **columns("key")).fit(known)
    stream = stream_of(spark, sf_dir, "part").withColumn("key", F.concat_ws(" ", "p_name", "p_brand"))
    coded = encode_stream(model, stream).select("p_partkey", rounded(vector_to_array("code")[0]).alias("code"))
    return drained(spark, coded, "unseen")


def gamma_poisson_stream(spark, sf_dir):
    """Topics fitted micro-batch by micro-batch, then used to encode."""
    talks = table(spark, sf_dir, "conversations")
    feed = scratch_path(spark, "feed")
    talks.repartition(4, "conv_id").write.parquet(feed)
    stream = spark.readStream.schema(talks.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    encoder = GammaPoissonEncoder(nTopics=5, rho=0.95, hashing=True, nFeatures=1024, **columns("text"))
    topics = IncrementalTopics(encoder, scratch_path(spark, "topics"))
    topics.start(stream, scratch_path(spark, "progress")).awaitTermination()
    coded = codes_of(topics.model(spark), talks, "text", 4)
    return coded.withColumn("key", F.md5("key"))


QUERIES = {f.__name__: f for f in (minhash_stream, unseen_category_policy, gamma_poisson_stream)}

ORACLES = {
    "minhash_stream": _minhash_sql("customer", "c_name", 10) + """
        SELECT c_custkey, component, round(value, 9) + 0.0e0 AS value FROM codes JOIN customer ON key = c_name""",
    "unseen_category_policy": TARGET_SQL.format("p_name || ' ' || p_brand").replace("FROM part", "FROM part WHERE p_type <> 'PROMO'") + """
        SELECT p_partkey, round(coalesce(share * own + (1 - share) * w.mean, a.mean), 6) + 0.0e0 AS code
        FROM part LEFT JOIN w ON w.key = p_name || ' ' || p_brand, a""",
}
