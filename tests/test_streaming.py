"""Streams: same values as batch, replay without double counting."""

import numpy as np
from pyspark.ml.functions import vector_to_array

from lexiloom.operators.grams import MinHashEncoder, TermCountEncoder
from lexiloom.operators.lookup import OneHotEncoder, TargetMeanEncoder
from lexiloom.operators.topics import GammaPoissonEncoder
from lexiloom.session import scratch_path
from lexiloom.streaming import encode_stream
from lexiloom.streaming.topics import IncrementalTopics

IO = {"inputCol": "s", "outputCol": "code"}


def run(spark, df, model):
    path = scratch_path(spark, "stream")
    df.repartition(3).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out = encode_stream(model, stream).select("id", vector_to_array("code").alias("a"))
    query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/p").trigger(availableNow=True).start()
    query.awaitTermination()
    return {r["id"]: r["a"] for r in spark.read.parquet(f"{path}/out").collect()}


def test_stream_equals_batch(spark, edge):
    for encoder in (MinHashEncoder(nComponents=4, **IO), TermCountEncoder(nFeatures=16, **IO), OneHotEncoder(**IO),
                    TargetMeanEncoder(**IO), GammaPoissonEncoder(nTopics=2, maxIter=1, **IO)):
        model = encoder.fit(edge)
        batch = {r["id"]: r["a"] for r in model.transform(edge).select("id", vector_to_array("code").alias("a")).collect()}
        streamed = run(spark, edge, model)
        assert set(batch) == set(streamed)
        assert all(np.allclose(batch[i], streamed[i]) for i in batch)


def test_replayed_batch_counts_once(spark, edge):
    def state(order):
        topics = IncrementalTopics(GammaPoissonEncoder(nTopics=2, rho=0.9, **IO), scratch_path(spark, "state"))
        for batch in order:
            topics.partial_fit(edge.filter(f"id % 2 = {batch % 2}"), batch)
        return topics, topics.model(spark).weights()

    topics, once = state([0, 1, 2])
    _, again = state([0, 1, 1, 2, 2])
    assert np.allclose(once, again) and topics.versions(spark) == [0, 1, 2]
    topics.partial_fit(edge.filter("false"), 3)
    assert topics.versions(spark) == [0, 1, 2]


def test_old_versions_go_and_r_gives_the_memory(spark, edge):
    topics = IncrementalTopics(GammaPoissonEncoder(nTopics=2, r=0.5, batchSize=4, **IO), scratch_path(spark, "state"))
    for batch in range(5):
        topics.partial_fit(edge, batch)
    assert topics.versions(spark) == [2, 3, 4]
    meta = topics._load(spark, 4)[0]
    assert np.isclose(meta["rho"], 0.5 ** (4 / edge.count()))
    replayed = topics.model(spark).weights()
    topics.partial_fit(edge, 4)
    assert np.allclose(replayed, topics.model(spark).weights()) and topics.versions(spark) == [2, 3, 4]
