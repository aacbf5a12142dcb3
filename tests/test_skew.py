"""One string in nine tenths of the rows: no task gets its rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom import session
from lexiloom.operators.grams import TermCountEncoder
from lexiloom.operators.lookup import leave_one_out_train


@pytest.fixture()
def hot(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_CELLS", 3000)  # 2,000 strings are too many to be broadcast
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    rows = spark.range(0, 20_000, 1, 8).select(
        "id", F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("s"),
        (F.col("id") % 7).cast("double").alias("y"))
    yield rows
    for k, v in before.items():
        spark.conf.set(k, v)


def spread_over(df):
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(sizes) <= 3 * np.median(sizes)


def test_leave_one_out(hot):
    out = leave_one_out_train(hot, "s", "y", "code")
    assert out.count() == 20_000
    near = out.filter("s = 'hot'")
    assert spread_over(near) and near.count() == 18_000
    total = sum(i % 7 for i in range(20_000) if i % 10)
    assert all(np.isclose(r["code"], (total - r["y"]) / 17_999) for r in near.limit(50).collect())
    overall = sum(i % 7 for i in range(20_000)) / 20_000
    assert {round(r["code"], 9) for r in out.filter("s <> 'hot'").collect()} == {round(overall, 9)}


def test_encoded_rows(hot):
    model = TermCountEncoder(inputCol="s", outputCol="code").fit(hot)
    out = model.transform(hot)
    assert spread_over(out.filter("s = 'hot'"))
    assert out.count() == 20_000 and out.filter("code is null").count() == 0
    assert out.select("id").distinct().count() == 20_000
