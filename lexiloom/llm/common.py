"""Helpers the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.session import scratch_path

ROW_GROUP = 16 << 20  # bytes a writing task buffers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents_of(docs: DataFrame) -> DataFrame:
    """The two columns the operators read; a null text stays null. Other columns are ignored."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def crc_of(doc_id: Column) -> Column:
    """crc32 of a doc_id written in decimal; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Row groups in order whose texts take about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    trim()


@lru_cache(maxsize=1)
def _unused() -> dict[str, Callable[[], object]]:
    """What tasks of this worker have left. Cached functions are the worker's own, where globals travel by value."""
    return {}


@lru_cache(maxsize=1)
def _libc():
    return ctypes.CDLL(None)


def in_use(name: str) -> None:
    """A worker's task goes on with what an earlier one left under this name."""
    _unused().pop(name, None)


def left_over(name: str, release: Callable[[], object]) -> None:
    """A task leaves something large for the next one of its kind; a task of another kind releases it."""
    _unused()[name] = release


def trim() -> None:
    """Give freed memory back to the system: Python workers live on, and other tasks need the room."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    if left := _unused():
        while left:
            left.popitem()[1]()
        trim()
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def joined(texts: list[bytes], gap: int = 0, fill: bytes = b"\0") -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, each text followed by ``gap`` filling bytes, and where each text starts (plus the end)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + gap
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    return np.frombuffer((fill * gap).join(texts) + fill * gap * bool(texts), np.uint8), starts


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values (the published splitmix64 one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Digests:
    """64-bit digests of any stretch of a byte array, from one polynomial sum over all of it."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(_powers[0]) < n:
            for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                steps = np.full(max(n, 1 << 20), base, np.uint64)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_LETTER[data] * _powers[0][:n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * _powers[1][start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * _powers[1][:n])
