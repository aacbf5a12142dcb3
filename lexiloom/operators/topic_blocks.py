"""Rows of topic fits in blocks, each with numbers that are carried from pass to pass.

Rows are packed once into blocks of a bounded number of entries and written by batch, so that an update reads its own
batch only. What a fit keeps per row (activations, distances) is a table with one row per block. Blocks are dealt by
their number once and stay where they are; a pass joins the carried numbers to them, which moves those alone. Weights
come as an array of a checked size, or as a table by term of which each block gets its own terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexiloom.functions.sparse import gram_counts, gram_struct
from lexiloom.functions.text import collapsed
from lexiloom.operators.subspace import times, uniforms
from lexiloom.session import scratch_path

BLOCK_ENTRIES = 200_000
BLOCKS_PER_TASK = 8
BLOCK = ("block long, marks array<long>, weights array<double>, sizes array<int>, terms array<int>, places array<int>, "
         "values array<double>, batch int")
FIELDS = ("marks", "weights", "sizes", "terms", "places", "values")
CARRIED = "block long, carried array<double>"
# Rounds of candidates for starting rows, and candidates in each for every row wanted.
ROUNDS = 3
PER_ROUND = 5
# Rows for every row wanted up to which all of them are candidates.
ALL_ROWS = 30


class RowBlocks:
    """(key, count, features) in blocks; a row's batch depends on its string only.

    With ``hashed``, the arguments of a hashed ``Terms`` block of characters, features are counted here from the keys, some
    texts at a time, and packed where they are counted: all features of a batch of rows together would take many times
    the room of their texts, in Python and, on their way, outside the JVM's heap.
    """

    def __init__(self, rows: DataFrame, batches: int = 1, seed: int = 0, hashed: tuple[int, int, int] | None = None):
        spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "rows")
        which = F.pmod(F.xxhash64("key"), F.lit(batches)).cast("int")
        features = F.col("features") if hashed is None else collapsed(F.col("key")).alias("text")
        (rows.select(which.alias("batch"), F.xxhash64("key", F.lit(seed)).alias("mark"), "count", features)
         .mapInArrow(_packer(BLOCK_ENTRIES, hashed), BLOCK).write.partitionBy("batch").parquet(path))
        self.whole = spark.read.schema(BLOCK).parquet(path)
        found = self.whole.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("sizes")).alias("rows")).collect()
        self.blocks = {r["batch"]: r["n"] for r in found}
        self.rows = sum(r["rows"] for r in found)
        self._held: dict[int | None, DataFrame] = {}

    def _parts(self, batch: int | None) -> int:
        n = sum(self.blocks.values()) if batch is None else self.blocks.get(batch, 0)
        return max(1, min(n, self.whole.sparkSession.sparkContext.defaultParallelism), n // BLOCKS_PER_TASK)

    def table(self, batch: int | None) -> DataFrame:
        """A batch's blocks (all for None), dealt by number and kept on the executors' disks."""
        if batch not in self._held:
            own = self.whole if batch is None else self.whole.filter(F.col("batch") == batch)
            self._held[batch] = own.drop("batch").repartition(self._parts(batch), "block").persist(StorageLevel.DISK_ONLY)
        return self._held[batch]

    def release(self, batch: int | None) -> None:
        if batch in self._held:
            self._held.pop(batch).unpersist()

    def close(self) -> None:
        for batch in list(self._held):
            self.release(batch)

    def run(self, batch: int | None, carried: DataFrame | None, work: Callable, schema: str, weights=None, k: int = 0) -> DataFrame:
        """What ``work(block, carried, w)`` yields as record batches for each block.

        ``carried`` holds an earlier result (block, carried) or nothing; ``weights`` is a K x V array, a table (term, w)
        or nothing, and ``w`` the K x n part of the block's terms.
        """
        blocks = self.table(batch)
        if carried is not None:
            blocks = blocks.join(carried.repartition(self._parts(batch), "block"), "block")
        fields, kind = FIELDS + ("carried",) * (carried is not None), to_arrow_schema(StructType.fromDDL(schema))
        if isinstance(weights, DataFrame):
            needed = self.table(batch).select((F.col("block") + 0).alias("slice"), F.explode("terms").alias("term"))
            slices = needed.join(weights.select("term", "w"), "term")

            def with_slice(rows: pa.Table, own: pa.Table) -> pa.Table:
                (block,) = _arrays(rows, fields)
                order = np.argsort(own["term"].to_numpy())
                w = own["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)[order].T
                return _together(work(block, block.get("carried"), np.ascontiguousarray(w)), kind)

            return blocks.groupBy("block").cogroup(slices.groupBy("slice")).applyInArrow(with_slice, schema)
        sent = None if weights is None else self.whole.sparkSession.sparkContext.broadcast(weights)

        def alone(rows: pa.Table) -> pa.Table:
            (block,) = _arrays(rows, fields)
            w = None if sent is None else sent.value[:, block["terms"]]
            return _together(work(block, block.get("carried"), w), kind)

        return blocks.groupBy("block").applyInArrow(alone, schema)


def _together(parts: Iterable[pa.RecordBatch], kind: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([p.cast(kind) for p in parts], kind)


def _arrays(rows: pa.Table, fields: tuple[str, ...]) -> list[dict]:
    return [{"number": rows["block"][i].as_py(), **{f: rows[f][i].values.to_numpy(zero_copy_only=False) for f in fields}}
            for i in range(rows.num_rows)]


def _counted(batches: Iterable[pa.RecordBatch], hashed: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """Batches of some texts' features at a time."""
    for batch in batches:
        for first, last, *counts in gram_counts(batch.column("text"), *hashed):
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, last - first) for c in ("batch", "mark", "count")),
                                              gram_struct([counts])], ["batch", "mark", "count", "features"])


def _packer(entries: int, hashed: tuple[int, int, int] | None = None) -> Callable:
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, tuple[int, list]] = {}

        def block(batch: int) -> pa.RecordBatch:
            nonlocal number
            sizes, marks, counts, index, values = (np.concatenate(x) for x in zip(*held.pop(batch)[1]))
            terms, places = np.unique(index, return_inverse=True)
            number += 1
            lists = (marks, counts.astype(float), sizes.astype(np.int32), terms.astype(np.int32), places.astype(np.int32), values)
            return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x]) for x in lists), pa.array([batch], pa.int32())],
                                              ["block", *FIELDS, "batch"])

        for rows in batches if hashed is None else _counted(batches, hashed):
            which, features = rows.column("batch").to_numpy(), rows.column("features")
            sizes = features.field("indices").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            index, values = (features.field(f).flatten().to_numpy(zero_copy_only=False) for f in ("indices", "values"))
            marks, counts = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("mark", "count"))
            starts = np.append(0, np.cumsum(sizes, dtype=np.int64))
            for batch in np.unique(which).tolist():
                own = np.flatnonzero(which == batch)
                filled = np.cumsum(sizes[own])
                first = 0
                while first < len(own):
                    size, parts = held.setdefault(batch, (0, []))
                    before = int(filled[first - 1]) if first else 0
                    last = max(first + 1, int(np.searchsorted(filled, before + entries - size, "right")))
                    some = own[first:last]
                    inside = np.repeat(starts[some] - (np.cumsum(sizes[some]) - sizes[some]), sizes[some]) + np.arange(sizes[some].sum())
                    parts.append((sizes[some], marks[some], counts[some], index[inside], values[inside]))
                    held[batch] = (size + len(inside), parts)
                    first = last
                    if held[batch][0] >= entries or first < len(own):
                        yield block(batch)
        for batch in list(held):
            yield block(batch)

    return pack


def carried_row(block: dict, numbers: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block["number"]]), pa.array([np.ascontiguousarray(numbers, dtype=float).ravel()])],
                                      ["block", "carried"])


# --- starting rows -----------------------------------------------------------------------


def _squares(block: dict) -> np.ndarray:
    rows = np.repeat(np.arange(len(block["sizes"])), block["sizes"])
    return np.bincount(rows, weights=block["values"] ** 2, minlength=len(block["sizes"]))


def _distances(block: dict, chosen: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Squared distances of a block's rows to given sparse rows."""
    terms = block["terms"]
    m = np.zeros((len(terms), len(chosen)))
    for j, (index, values) in enumerate(chosen):
        at = np.searchsorted(terms, index)
        met = np.flatnonzero(at < len(terms))
        met = met[terms[at[met]] == index[met]]
        m[at[met], j] = values[met]
    inner = times(block["sizes"], block["places"].astype(np.int64), block["values"], m)
    size = np.array([(v ** 2).sum() for _, v in chosen])
    return np.maximum(_squares(block)[:, None] + size - 2 * inner, 0)


def _nearest(block: dict, carried: np.ndarray | None, chosen: list, first: int) -> np.ndarray:
    """Each row's squared distance to its nearest candidate, and that candidate's number."""
    far = _distances(block, chosen)
    near = far.argmin(axis=1)
    best, owner = far[np.arange(len(near)), near], near + first
    if carried is not None:
        old, old_owner = carried.reshape(2, -1)
        best, owner = np.where(best < old, best, old), np.where(best < old, owner, old_owner)
    return np.stack((best, owner))


def _rows_table(block: dict, some: np.ndarray) -> pa.RecordBatch:
    """(mark, indices, values) of some rows of a block."""
    ends = np.cumsum(block["sizes"])
    spans = [slice(ends[i] - block["sizes"][i], ends[i]) for i in some]
    return pa.RecordBatch.from_arrays(
        [pa.array(block["marks"][some]), pa.array([block["terms"][block["places"][s]] for s in spans], pa.list_(pa.int32())),
         pa.array([block["values"][s] for s in spans], pa.list_(pa.float64()))], ["mark", "indices", "values"])


ROWS = "mark long, indices array<int>, values array<double>"


def _collected(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """A bounded number of rows, in an order that does not depend on partitions."""
    found = sorted(((r["mark"], tuple(r["indices"]), tuple(r["values"])) for r in rows.collect()))
    return [(np.array(i, np.int64), np.array(v, float)) for _, i, v in found]


def candidates(blocks: RowBlocks, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Rows from which k starting rows are drawn, and how many rows each is nearest to.

    Every row can become one: in each round a row is taken with a chance in proportion to its squared distance from
    those taken before, so that about ``PER_ROUND`` x k rows come. The chance uses a digest of the row's string.
    """
    if blocks.rows <= ALL_ROWS * k:
        found = _collected(blocks.run(None, None, lambda b, _, w: [_rows_table(b, np.arange(len(b["sizes"])))], ROWS))
        return found, np.ones(len(found))

    def smallest(block: dict, carried, w):
        yield _rows_table(block, np.array([block["marks"].argmin()]))

    heads = blocks.run(None, None, smallest, ROWS)
    found = _collected(heads.orderBy("mark").limit(1))
    first, near = 0, None
    for turn in range(ROUNDS):
        new, from_ = found[first:], first
        near = settled_blocks(blocks.run(None, near, lambda b, c, w: [carried_row(b, _nearest(b, c, new, from_))], CARRIED))
        size = F.aggregate(F.slice("carried", F.lit(1), (F.size("carried") / 2).cast("int")), F.lit(0.0), lambda s, x: s + x)
        total = near.agg(F.sum(size)).first()[0]
        if not total:
            break

        def take(block: dict, carried: np.ndarray, w):
            chance = PER_ROUND * k * carried.reshape(2, -1)[0] / total
            mark = block["marks"].view(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            yield _rows_table(block, np.flatnonzero(uniforms(mark) < chance))

        first = len(found)
        found = found + _collected(blocks.run(None, near, take, ROWS))
        if len(found) == first:
            break

    new, from_ = found[first:], first

    def count(block: dict, carried: np.ndarray, w):
        owner = (_nearest(block, carried, new, from_) if new else carried.reshape(2, -1))[1].astype(np.int64)
        which, n = np.unique(owner, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(n)], ["candidate", "n"])

    weights = np.zeros(len(found))
    for r in blocks.run(None, near, count, "candidate long, n long").groupBy("candidate").agg(F.sum("n").alias("n")).collect():
        weights[r["candidate"]] = r["n"]
    return found, weights


def settled_blocks(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "carried")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def starting_rows(blocks: RowBlocks, k: int, seed: int) -> list[dict]:
    """k rows drawn from the candidates by squared-distance seeding, a candidate counting as the rows nearest to it."""
    few, weights = candidates(blocks, k)
    blocks.release(None)
    rng = np.random.RandomState(seed)
    terms = np.unique(np.concatenate([i for i, _ in few])) if few else np.zeros(0, np.int64)
    sizes = np.array([len(i) for i, _ in few], np.int64)
    block = {"sizes": sizes, "terms": terms, "places": np.searchsorted(terms, np.concatenate([i for i, _ in few])) if few else terms,
             "values": np.concatenate([v for _, v in few]) if few else np.zeros(0)}
    picks, far = [], None
    for _ in range(k if few else 0):
        chance = weights if far is None else weights * far
        total = chance.sum()
        pick = rng.choice(len(few), p=chance / total) if total > 0 else rng.randint(len(few))
        picks.append({"indices": few[pick][0], "values": few[pick][1]})
        own = _distances(block, [few[pick]])[:, 0]
        far = own if far is None else np.minimum(far, own)
    return picks
