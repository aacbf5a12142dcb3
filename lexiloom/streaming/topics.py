"""Incremental gamma-Poisson fit over the micro-batches of a stream."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiloom.operators.topics import (
    TINY, GammaPoissonEncoder, GammaPoissonModel, blocks_of, poisson_pass, term_rows,
)
from lexiloom.sources.derived import remove_table, table_exists

# Newest versions of the state that stay: a replayed batch needs the one before its own.
KEPT = 3


class IncrementalTopics:
    """State (W, A, B) as one table per micro-batch below ``state_path``.

    Batch ``n`` starts from the newest version below ``n`` and writes version ``n``
    afresh, so a replayed batch gives the same state instead of counting twice. Only
    the newest ``KEPT`` versions stay. The memory per batch is ``rho``, or follows from
    ``r`` and the first batch's rows where ``r`` is set.
    """

    def __init__(self, encoder: GammaPoissonEncoder, state_path: str):
        self.encoder, self.path = encoder, state_path.rstrip("/")

    def _version(self, batch_id: int) -> str:
        return f"{self.path}/version={batch_id}"

    def versions(self, spark: SparkSession) -> list[int]:
        if not table_exists(spark, self.path):
            return []
        return sorted(r[0] for r in spark.read.parquet(self.path).select("version").distinct().collect())

    def partial_fit(self, df: DataFrame, batch_id: int) -> None:
        """One activation pass and one weight update from a batch of rows."""
        spark, encoder = df.sparkSession, self.encoder
        keys = encoder.keys(df).persist()
        if keys.isEmpty():
            keys.unpersist()
            return
        earlier = [v for v in self.versions(spark) if v < batch_id]
        if earlier:
            meta, tables, w, a, b = self._load(spark, earlier[-1])
            rho = meta["rho"]
            rows = term_rows(keys, blocks_of(meta, tables)).persist()
        else:
            meta, tables, rows, w = encoder.begin(df, keys)
            for name, table in tables.items():
                table.write.mode("overwrite").parquet(f"{self.path}-{name}")
            a = np.full(w.shape, TINY)
            b = np.full((len(w), 1), TINY)
            rho = encoder.get("rho") if encoder.isSet("rho") else 0.99
            if encoder.isSet("r"):
                rho = encoder.get("r") ** min(1.0, encoder.get("batchSize") / keys.agg(F.sum("count")).first()[0])
            meta = {**meta, "rho": rho}
        w, a, b = poisson_pass(rows, {**encoder.prior(), "W": w}, a, b, rho)
        self._save(spark, batch_id, meta, w, a, b)
        for version in [v for v in earlier if v < batch_id][:1 - KEPT]:
            remove_table(spark, self._version(version))
        rows.unpersist()
        keys.unpersist()

    def _save(self, spark: SparkSession, batch_id: int, meta: dict, w, a, b) -> None:
        rows = [(i, json.dumps(meta), w[i].tolist(), a[i].tolist(), float(b[i, 0])) for i in range(len(w))]
        table = spark.createDataFrame(rows, "topic int, meta string, w array<double>, a array<double>, b double")
        table.write.mode("overwrite").parquet(self._version(batch_id))

    def _load(self, spark: SparkSession, version: int):
        rows = spark.read.parquet(self._version(version)).orderBy("topic").collect()
        meta = json.loads(rows[0]["meta"])
        tables = {b["terms"]: spark.read.parquet(f"{self.path}-{b['terms']}") for b in meta["blocks"]
                  if table_exists(spark, f"{self.path}-{b['terms']}")}
        w, a = (np.array([r[c] for r in rows]) for c in ("w", "a"))
        return meta, tables, w, a, np.array([[r["b"]] for r in rows])

    def model(self, spark: SparkSession) -> GammaPoissonModel:
        """Encoder from the newest version."""
        meta, tables, w, _, _ = self._load(spark, self.versions(spark)[-1])
        encoder = self.encoder
        meta = {**meta, "width": len(w), "state": encoder.prior(), "transform_steps": encoder.get("transformSteps")}
        weights = encoder.weights_table(spark.range(0), w)
        words = spark.createDataFrame([], "word string")
        return encoder.build(GammaPoissonModel({**tables, "weights": weights, "words": words}, meta))

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = stream.select(F.col(self.encoder.getInputCol())).writeStream
        return (writer.foreachBatch(self.partial_fit).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())
