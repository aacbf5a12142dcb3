"""Topic weights as a table with one row per term, for any number of topics and terms.

Rows are dealt into blocks of a bounded number of entries. A pass joins each block's terms with
their weights once, so that a task holds its own slice of the weights only, and adds up the block's
statistics per term before the shuffle. The driver keeps sums over all terms: K numbers, or K x K.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import checkpointed

# Entries of a block of rows.
BLOCK_ENTRIES = 200_000


def blocked(rows: DataFrame) -> DataFrame:
    """The rows with the block they are in, by a digest of their string."""
    entries = rows.agg(F.sum(F.size("features.indices"))).first()[0] or 0
    return rows.withColumn("_block", F.pmod(F.xxhash64("key"), F.lit(1 + entries // BLOCK_ENTRIES)))


def _slices(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(_slice, term, w): the weights of the terms each block holds, the block's number under another name."""
    needed = rows.select("_block", F.explode("features.indices").alias("_i")).select(
        (F.col("_block") + 0).alias("_slice"), F.col("_i").cast("bigint").alias("term")).distinct()
    return needed.join(weights.select("term", "w"), "term").select("_slice", "term", "w")


def _matrix(column: pa.ChunkedArray, k: int) -> np.ndarray:
    """Lists of K numbers as a K x n array."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k).T


def _local(rows: pa.Table, slices: pa.Table, k: int):
    """Features renumbered by place in the block's slice, the slice's terms, and its weights."""
    terms = slices["term"].to_numpy()
    order = np.argsort(terms)
    features = rows["features"].combine_chunks()
    lists = features.field("indices")
    place = np.searchsorted(terms[order], lists.flatten().to_numpy(zero_copy_only=False)).astype(np.int32)
    renumbered = pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int32)),
                                  pa.array(place)),
         pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int32)),
                                  features.field("values").flatten())], names=["indices", "values"])
    return renumbered, terms[order], np.ascontiguousarray(_matrix(slices["w"], k)[:, order])


def _by_block(rows: DataFrame, weights: DataFrame, columns: list[str], work: Callable, schema: str) -> DataFrame:
    left = rows.select("_block", *columns, "features")
    return left.groupBy("_block").cogroup(_slices(rows, weights).groupBy("_slice")).applyInArrow(work, schema)


def accumulate(rows: DataFrame, weights: DataFrame, k: int, n_extra: int, state: dict, step: Callable) -> tuple[DataFrame, np.ndarray]:
    """A step's statistics: a table (term, s) of K sums per term, and K x n_extra sums beside them."""
    from lexiloom.operators.topics import chunks

    def work(block: pa.Table, slices: pa.Table) -> pa.Table:
        features, terms, w = _local(block, slices, k)
        sums, beside = np.zeros((k, len(terms))), np.zeros((k, n_extra))
        weight = block["count"].to_numpy().astype(float)
        for part in chunks(features, weight, k):
            (index, by_term), extra = step(part, {**state, "W": w})
            sums[:, index] += by_term
            beside += extra
        out = np.concatenate((sums, beside), axis=1)
        names = np.concatenate((terms, -1 - np.arange(n_extra)))
        return pa.table({"term": pa.array(names.astype(np.int64)), **{f"s{j}": pa.array(out[j]) for j in range(k)}})

    schema = "term bigint, " + ", ".join(f"s{j} double" for j in range(k))
    summed = checkpointed(_by_block(rows, weights, ["count"], work, schema).groupBy("term").agg(
        *[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]))
    beside = np.zeros((k, n_extra))
    for row in summed.filter("term < 0").collect():
        beside[:, -1 - row["term"]] = row[1:]
    return summed.filter("term >= 0").select("term", F.array(*[f"s{j}" for j in range(k)]).alias("s")), beside


def codes(rows: DataFrame, weights: DataFrame, k: int, state: dict, step: Callable) -> DataFrame:
    """(key, features): the dense code ``step`` gives each row."""
    from lexiloom.operators.topics import chunks

    def work(block: pa.Table, slices: pa.Table) -> pa.Table:
        features, _, w = _local(block, slices, k)
        parts = [step(part, {**state, "W": w}) for part in chunks(features, np.ones(len(block)), k)]
        out = np.concatenate(parts, axis=1).T if parts else np.zeros((0, k))
        offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * k)
        return pa.table({"key": block["key"], "features": pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(out).ravel()))})

    return _by_block(rows, weights, ["key"], work, "key string, features array<double>")


def updated(weights: DataFrame, sums: DataFrame, k: int, change: Callable) -> DataFrame:
    """Weights after ``change``, a function of the K x n arrays (w, a, s) that gives new (w, a); ``before`` keeps w.

    Terms without statistics have sums of zero.
    """
    zeros = F.array_repeat(F.lit(0.0), k)
    joined = weights.select("term", "w", "a").join(sums, "term", "left").withColumn("s", F.coalesce("s", zeros))

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            w, a, s = (_matrix(pa.chunked_array([batch.column(c)]), k) for c in ("w", "a", "s"))
            new, kept = change(w, a, s)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x.T).ravel())) for x in (new, kept, w)]
            yield pa.RecordBatch.from_arrays([batch.column("term"), *lists], ["term", "w", "a", "before"])

    return checkpointed(joined.mapInArrow(work, "term bigint, w array<double>, a array<double>, before array<double>"))


def sums_of(weights: DataFrame, column: str, k: int) -> np.ndarray:
    """K sums over all terms."""
    row = weights.agg(*[F.sum(F.col(column)[j]).alias(f"s{j}") for j in range(k)]).first()
    return np.array([x or 0.0 for x in row])


def gram_of(weights: DataFrame, k: int) -> np.ndarray:
    """K x K products of the topics; every task adds up its own terms."""
    def work(batches):
        total = np.zeros((k, k))
        for batch in batches:
            w = _matrix(pa.chunked_array([batch.column("w")]), k)
            total += w @ w.T
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int64()), pa.array(list(total))], ["i", "g"])

    parts = weights.select("w").mapInArrow(work, "i bigint, g array<double>")
    rows = parts.groupBy("i").agg(*[F.sum(F.col("g")[j]).alias(f"g{j}") for j in range(k)]).collect()
    out = np.zeros((k, k))
    for row in rows:
        out[row["i"]] = row[1:]
    return out


def scaled(weights: DataFrame, size: np.ndarray, columns: tuple[str, ...]) -> DataFrame:
    """The named columns with topic j divided by ``size[j]``."""
    by = F.array(*[F.lit(float(x)) for x in size])
    return weights.withColumns({c: F.zip_with(c, by, lambda x, y: x / y) for c in columns})


def moved(weights: DataFrame) -> float:
    """Relative change of the weights from ``before``, in the Frobenius norm."""
    square = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    row = weights.select(F.zip_with("w", "before", lambda x, y: x - y).alias("d"), "before").agg(square("d"), square("before")).first()
    return float(np.sqrt(row[0]) / np.sqrt(row[1]))


def drawn(seed: int, terms, draw: Callable) -> np.ndarray:
    """A row of random numbers for each term, from a generator of its own."""
    return np.stack([draw(np.random.RandomState([seed, int(t)])) for t in terms])


def drawn_table(spark, width: int, seed: int, draw: Callable) -> DataFrame:
    """(term, w) of the same numbers."""
    def work(batches):
        for batch in batches:
            if batch.num_rows:
                values = drawn(seed, batch.column("term").to_numpy(), draw)
                yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(list(values), pa.list_(pa.float64()))], ["term", "w"])

    return spark.range(width).withColumnRenamed("id", "term").mapInArrow(work, "term bigint, w array<double>")


def from_sparse(spark, entries: list[tuple[int, int, float]], k: int, width: int, floor: float, unit: bool = True) -> DataFrame:
    """(term, w): ``floor`` everywhere plus the given (topic, term, value) entries; with ``unit``, each topic's weights
    sum to one."""
    size = np.full(k, floor * width)
    for topic, _, value in entries:
        size[topic] += value
    if not unit:
        size[:] = 1
    given = spark.createDataFrame(entries, "topic int, term bigint, value double").groupBy("term").agg(
        F.map_from_entries(F.collect_list(F.struct("topic", "value"))).alias("_v"))
    topics = F.array(*[(F.lit(floor) + F.coalesce(F.try_element_at("_v", F.lit(j)), F.lit(0.0))) / F.lit(float(size[j])) for j in range(k)])
    return spark.range(width).withColumnRenamed("id", "term").join(given, "term", "left").select("term", topics.alias("w"))
