"""Token ids of a corpus as files of independently decodable blocks (see rans.py).

A corpus folder holds ``model`` (id, frequency: the table all blocks share) and ``blocks``: Parquet files in
ascending order of doc_id whose rows are blocks of whole documents. A block row has the number of its file
range and of its first id there, its documents with their lengths, and the coded ids with checkpoints and a
checksum. Blocks need only the model, so any number of readers decode them at the same time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import documents_of, slices, texts_of, written
from lexiloom.llm.rans import Model, scaled
from lexiloom.llm.tokens import END_ID, piece_encoder

BLOCK_TOKENS = 1 << 18
RANGE_BYTES = 64 << 20
BLOCKS = ("file_range int, first long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary")


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and the ids of each whole text with ``end_id`` behind them, as little-endian 16-bit numbers where
    the vocabulary allows, else 32-bit (``width`` bytes each)."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with piece_encoder(vocabulary) as encoder:
            kind = "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
            for batch in slices(batches, "text"):
                ids, bounds = encoder.flat(texts_of(batch))
                ids = np.insert(ids.astype(kind), bounds[1:], end_id)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), _binary(ids, bounds + np.arange(len(bounds))),
                     pa.array(np.full(batch.num_rows, int(kind[-1]), np.int32))], ["doc_id", "ids", "width"])

    return documents_of(docs).mapInArrow(encode, "doc_id long, ids binary, width int")


def _binary(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The ids between each two bounds as a binary value."""
    offsets = pa.py_buffer(ids.itemsize * bounds.astype(np.int64))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(ids)]) \
        .cast(pa.binary())


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch, and where each row's start there (plus the end). A table's ids have one width."""
    ids = batch.column("ids").cast(pa.large_binary())
    if not len(ids):
        return np.zeros(0, "<u4"), np.zeros(1, np.int64)
    width = batch.column("width")[0].as_py()
    bounds = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset:ids.offset + len(ids) + 1]
    data = np.frombuffer(ids.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
    return data.view(f"<u{width}"), (bounds - bounds[0]) // width


def frequencies(tokens: DataFrame) -> DataFrame:
    """How often each id occurs; every task adds up its own before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(_flat(batch)[0], minlength=len(total))
            seen[:len(total)] += total
            total = seen
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["id", "n"])

    return tokens.select("ids", "width").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_corpus(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID) -> None:
    """Write the folder described above.

    A null text counts as empty and gives ``end_id`` alone; null doc_ids come first; rows with equal ids are all
    written, in the order of their ids; an empty table gives an empty corpus.
    """
    spark = docs.sparkSession
    tokens = written(tokenized(docs, vocabulary, end_id), "tokens")
    counted = frequencies(tokens).toArrow()  # at most as many rows as the vocabulary
    counts = np.zeros(1 + max(counted["id"].to_pylist(), default=-1), np.int64)
    counts[counted["id"].to_numpy()] = counted["n"].to_numpy()
    shares = scaled(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(shares.tolist()) if f], "id long, frequency long") \
        .coalesce(1).write.parquet(f"{path}/model")
    stored = tokens.agg(F.sum(F.length("ids"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored // RANGE_BYTES)
    table = shares.astype("<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number, first = _model(table), TaskContext.get().partitionId(), 0
        waiting: list[tuple[int | None, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            nonlocal first, waiting
            ids = np.concatenate([x for _, x in waiting])
            row = [[number], [first], [len(ids)], [[d for d, _ in waiting]], [[len(x) for _, x in waiting]],
                   [model.encode(ids)]]
            first, waiting = first + len(ids), []
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)],
                                              [c.split()[0] for c in BLOCKS.split(", ")])

        held = 0
        for batch in batches:
            flat, bounds = _flat(batch)
            bounds = bounds.tolist()
            for doc_id, start, stop in zip(batch.column("doc_id").to_pylist(), bounds, bounds[1:]):
                waiting.append((doc_id, flat[start:stop]))
                held += stop - start
                if held >= BLOCK_TOKENS:
                    yield block()
                    held = 0
        if waiting:
            yield block()

    (tokens.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first())
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
     .mapInArrow(encode, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks"))


@lru_cache(maxsize=2)
def _model(table: bytes) -> Model:
    return Model(np.frombuffer(table, "<u4").astype(np.int64))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit) of every document."""
    model = spark.read.schema("id long, frequency long").parquet(f"{path}/model").toArrow()  # vocabulary-sized
    shares = np.zeros(1 + max(model["id"].to_pylist(), default=-1), "<u4")
    shares[model["id"].to_numpy()] = model["frequency"].to_numpy()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = {r.file_range: r.n for r in blocks.groupBy("file_range").agg(F.sum("n_tokens").alias("n")).collect()}
    before, base = {}, 0  # one number for each file range
    for number in sorted(sizes):
        before[number] = base
        base += sizes[number]
    table = shares.tobytes()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _model(table)
        for batch in slices(batches, "payload", 1 << 20):
            for row in batch.to_pylist():
                ids = coder.decode(row["payload"]).astype("<u4", copy=False)
                bounds = np.append(0, np.cumsum(row["lengths"], dtype=np.int64))
                if len(ids) != row["n_tokens"] or bounds[-1] != len(ids):
                    raise ValueError("block does not hold its documents")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(bounds[:-1] + before[row["file_range"]] + row["first"]),
                     _binary(ids, bounds)], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(decode, "doc_id long, start long, ids binary")
