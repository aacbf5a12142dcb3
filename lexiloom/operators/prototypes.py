"""Prototype categories: the most frequent, or the strings nearest to k-means centres."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.sparse import gram_vector
from lexiloom.functions.text import collapsed

# Width of the hashed n-gram space in which strings are clustered.
HASH_WIDTH = 128


def hashed_profiles(keys: DataFrame, width: int = HASH_WIDTH, lo: int = 2, hi: int = 4) -> DataFrame:
    """(key, count, features): hashed n-gram counts of each distinct string, sparse."""
    return keys.select("key", "count", gram_vector(collapsed(F.col("key")), width, lo, hi).alias("features"))


def kmeans_prototypes(keys: DataFrame, k: int, seed: int = 0, width: int = HASH_WIDTH) -> DataFrame:
    """(key, count) of the distinct strings closest to the centres; may be fewer than k.

    The clustering draws its start by partition, so strings are placed and ordered first:
    the result then does not depend on how the table was partitioned.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.repartition(parts, "key").sortWithinPartitions("key")
    profiles = hashed_profiles(placed, width).persist()
    to_vector = F.udf(lambda f: SparseVector(width, f["indices"], f["values"]), VectorUDT())
    points = profiles.select("count", to_vector("features").alias("_v"))
    centers = np.array(KMeans(k=k, seed=seed, featuresCol="_v", weightCol="count").fit(points).clusterCenters())

    def nearest(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lists = table["features"].combine_chunks().field("indices")
            row = np.repeat(np.arange(len(table)), lists.value_lengths().to_numpy(zero_copy_only=False))
            dense = np.zeros((len(table), width))
            values = table["features"].combine_chunks().field("values").flatten()
            dense[row, lists.flatten().to_numpy(zero_copy_only=False)] = values.to_numpy(zero_copy_only=False)
            distance = ((dense ** 2).sum(axis=1)[:, None] + (centers ** 2).sum(axis=1) - 2 * dense @ centers.T)
            names = np.array(table["key"].to_pylist(), dtype=object)
            best = [min(zip(distance[:, j], names, range(len(names)))) for j in range(len(centers))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(centers))), pa.array([float(d) for d, _, _ in best]),
                 pa.array([name for _, name, _ in best]), table["count"].combine_chunks().take([i for _, _, i in best])],
                names=["center", "distance", "key", "count"])

    close = profiles.mapInArrow(nearest, "center bigint, distance double, key string, count bigint")
    best = close.groupBy("center").agg(F.min(F.struct("distance", "key", "count")).alias("best"))
    chosen = sorted({(r["best"]["key"], r["best"]["count"]) for r in best.collect()})
    profiles.unpersist()
    return keys.sparkSession.createDataFrame(chosen, "key string, count bigint")
