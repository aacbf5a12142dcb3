"""Hard negatives by a vertical scan with branch-and-bound over dimensions.

Vectors are turned to integers and kept in blocks of rows, one dimension after the other, with each dimension's
smallest and largest value in the block. For an anchor a block's dimensions are read in the order of the anchor's
falling magnitudes. After some dimensions every candidate has a partial score; the unread ones can add no less and no
more than the sums of their least and greatest products. A bitmap keeps the candidates whose bounds still reach the
result, and is thinned until scores are exact: for positives those whose upper bound reaches the k-th lower bound, for
negatives those that can lie in some window and there reach the k-th candidate that surely lies in it.

Two scans follow each other: the first finds each anchor's positives, the second its negatives in the windows of the
positives' scores. Blocks of rows meet blocks of anchors in an equi-join on the pair of blocks, so each pair is a group
of its own whatever the labels are, and only the best k per anchor (or window) and block leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import written
from lexiloom.session import small

ROWS = 8192  # of a block of rows at most
ANCHORS = 512  # of a block of anchors at most
CELLS = 1 << 19  # components of a block at most, unless one vector has more
GRAIN = 256  # a component x counts floor(GRAIN * x)
READ = 8  # dimensions between two thinnings of the bitmap
# Components up to this keep scores of 2^14 dimensions within 62 bits.
LARGEST = 1 << 24

BLOCK = "block long, length int, ids binary, labels binary, values binary"


def integers(rows: DataFrame) -> DataFrame:
    """(vec_id, label, q) of the rows that take part; q holds floor(256 x) of each component."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    sound = ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    q = F.transform("x", lambda e: F.floor(F.lit(float(GRAIN)) * e))
    bad = F.exists("x", lambda e: F.abs(F.lit(float(GRAIN)) * e) > float(LARGEST))
    kept = (rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("x"))
            .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(sound))
    large = F.raise_error(F.format_string("a component of vector %d is beyond %d", "vec_id", F.lit(LARGEST // GRAIN)))
    return kept.select("vec_id", "label", F.when(bad, large.cast("array<bigint>")).otherwise(q).alias("q"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of one vector length in blocks of at most ``size``, cut where the rows lie; values dimension by dimension."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, tuple[list, list, list]] = {}
        number = TaskContext.get().partitionId() << 32

        def block(length: int, limit: int) -> pa.RecordBatch:
            nonlocal number
            ids, labels, values = (np.concatenate(x) for x in held.pop(length))
            if len(ids) > limit:
                held[length] = ([ids[limit:]], [labels[limit:]], [values[limit:]])
            ids, labels, values = ids[:limit], labels[:limit], values[:limit]
            number += 1
            return pa.RecordBatch.from_pydict({
                "block": [number], "length": pa.array([length], pa.int32()), "ids": [ids.astype("<i8").tobytes()],
                "labels": [labels.astype("<i8").tobytes()], "values": [np.ascontiguousarray(values.T).astype("<i4").tobytes()]})

        for batch in batches:
            q = batch.column("q")
            sizes = np.diff(q.offsets.to_numpy())
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            values, starts = q.flatten().to_numpy(), np.cumsum(sizes) - sizes
            for length in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == length)
                own = held.setdefault(length, ([], [], []))
                for part, new in zip(own, (ids[at], labels[at], values[starts[at][:, None] + np.arange(length)])):
                    part.append(new)
                limit = min(size, max(1, CELLS // max(length, 1)))
                while length in held and sum(map(len, held[length][0])) >= limit:
                    yield block(length, limit)
        for length in list(held):
            yield block(length, size)

    return rows.select("vec_id", "label", "q").mapInArrow(cut, BLOCK)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["labels"], "<i8"), np.frombuffer(row["values"], "<i4").reshape(row["length"], len(ids))


def scan(values: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, rows: np.ndarray,
         thinned: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Rows left when all dimensions are read, and their exact scores.

    ``values`` holds a block's dimensions, ``low`` and ``high`` their ranges. ``thinned`` gets the candidates' lower and
    upper bounds and says which stay.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    # What the dimensions from each place of the order on can add at least and at most.
    ends = np.stack([low[order] * anchor[order], high[order] * anchor[order]])
    rest = np.zeros((2, len(order) + 1), np.int64)
    rest[0, :-1] = np.cumsum(ends.min(axis=0)[::-1])[::-1]
    rest[1, :-1] = np.cumsum(ends.max(axis=0)[::-1])[::-1]
    bitmap = np.zeros(values.shape[1], bool)
    bitmap[rows] = True
    partial = np.zeros(values.shape[1], np.int64)
    for at in range(0, len(order), READ):
        dims = order[at:at + READ]
        if len(rows) * 4 > len(bitmap):  # most are left: whole columns read faster than single places
            for d in dims:
                partial += values[d] * anchor[d]
        else:
            partial[rows] += anchor[dims] @ values[dims[:, None], rows]
        now = partial[rows]
        a, b = rest[0, min(at + READ, len(order))], rest[1, min(at + READ, len(order))]
        bitmap[rows] = thinned(now + a, now + b)
        rows = np.flatnonzero(bitmap)
        if not len(rows):
            break
    return rows, partial[rows]


def _reaching(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Candidates whose upper bound reaches the k-th largest lower bound."""
    return high >= np.partition(low, len(low) - k)[-k] if len(low) > k else np.ones(len(low), bool)


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _windows(scores: list[int], least: int, most: int) -> list[tuple[int, int, int]]:
    """(positive score, smallest, largest score of its negatives), in whole numbers."""
    return [(s, -(-least * s // 100), most * s // 100) for s in sorted(set(scores))]


def _compared(blocks: DataFrame, anchors: DataFrame, find: Callable[[dict, dict], np.ndarray], schema: str) -> DataFrame:
    """What ``find`` yields for each block of rows and each block of anchors of the same length.

    Both sides are dealt by the pair: rows are copied per block of anchors and anchors per block of rows, in blocks.
    """
    here = blocks.select("block", "length")
    there = anchors.select(F.col("block").alias("a_block"), "length")
    pairs = here.join(small(there, there.count(), 2), "length").select("block", "a_block")
    pair = ["block", "a_block"]
    left = pairs.join(blocks, "block")
    right = anchors.withColumnRenamed("block", "a_block").join(pairs, "a_block")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # new columns: both sides come from the same pairs

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        found = [find(x, y) for x in rows.to_pylist() for y in own.to_pylist()]
        names = [c.split()[0] for c in schema.split(",")]
        return pa.table([pa.array(c, pa.int64()) for c in np.concatenate(found, axis=1)], names)

    return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(run, schema)


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def _block(row: dict) -> tuple[np.ndarray, ...]:
    """Ids, labels, dimensions, and each dimension's smallest and largest value."""
    ids, labels, values = _unpacked(row)
    values = values.astype(np.int64)
    return ids, labels, values, values.min(axis=1, initial=LARGEST), values.max(axis=1, initial=-LARGEST)


def positives_of(blocks: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor_id, other_id, score, rank): of each anchor the first k other rows of its label."""

    def find(rows: dict, own: dict) -> np.ndarray:
        ids, labels, values, low, high = _block(rows)
        out = [np.zeros((3, 0), np.int64)]
        for a, label, vector in zip(*(x.T for x in _unpacked(own))):
            left = np.flatnonzero((labels == label) & (ids != a))
            if len(left):
                left, scores = scan(values, low, high, vector.astype(np.int64), left, lambda x, y: _reaching(x, y, k))
                best = _first(ids[left], scores, k)
                out.append(np.stack([np.full(len(best), a), ids[left[best]], scores[best]]))
        return np.concatenate(out, axis=1)

    return _top(_compared(blocks, anchors, find, "anchor_id long, other_id long, score long"), ["anchor_id"], k)


def _near_windows(windows: list[tuple[int, int, int]], k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Candidates that may lie in a window and there reach the k-th that surely does."""

    def thinned(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stays = np.zeros(len(low), bool)
        for _, first, last in windows:
            may = (high >= first) & (low <= last)
            sure = low[(low >= first) & (high <= last)]
            if len(sure) > k:
                may &= high >= np.partition(sure, len(sure) - k)[-k]
            stays |= may
        return stays

    return thinned


def negatives_of(blocks: DataFrame, anchors: DataFrame, k: int, least: int, most: int) -> DataFrame:
    """(anchor_id, positive_score, other_id, score, rank): the first k rows of other labels in each window."""

    def find(rows: dict, own: dict) -> np.ndarray:
        ids, labels, values, low, high = _block(rows)
        out = [np.zeros((4, 0), np.int64)]
        for a, label, vector, reached in zip(*(x.T for x in _unpacked(own)), own["scores"]):
            windows, left = _windows(reached, least, most), np.flatnonzero(labels != label)
            if not len(left):
                continue
            left, scores = scan(values, low, high, vector.astype(np.int64), left, _near_windows(windows, k))
            for positive, first, last in windows:
                inside = np.flatnonzero((scores >= first) & (scores <= last))
                best = inside[_first(ids[left[inside]], scores[inside], k)]
                out.append(np.stack([np.full(len(best), a), np.full(len(best), positive), ids[left[best]], scores[best]]))
        return np.concatenate(out, axis=1)

    schema = "anchor_id long, positive_score long, other_id long, score long"
    return _top(_compared(blocks, anchors, find, schema), ["anchor_id", "positive_score"], k)


def _with_scores(anchors: DataFrame, positives: DataFrame) -> DataFrame:
    """Anchor blocks again, each anchor with the scores of its positives."""
    scores = positives.groupBy("anchor_id").agg(F.collect_list("score").alias("scores"))
    return anchors.join(scores, anchors.vec_id == scores.anchor_id).select("vec_id", "label", "q", "scores")


def _scored_blocks(anchors: DataFrame) -> DataFrame:
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = batch.to_pylist()
            for length in sorted({len(r["q"]) for r in rows}):
                same = [r for r in rows if len(r["q"]) == length]
                step = min(ANCHORS, max(1, CELLS // max(length, 1)))
                for own in (same[i:i + step] for i in range(0, len(same), step)):
                    values = np.array([r["q"] for r in own], np.int64).reshape(len(own), length)
                    number += 1
                    yield pa.RecordBatch.from_arrays([
                        pa.array([number]), pa.array([length], pa.int32()),
                        pa.array([np.array([r["vec_id"] for r in own], "<i8").tobytes()]),
                        pa.array([np.array([r["label"] for r in own], "<i8").tobytes()]),
                        pa.array([np.ascontiguousarray(values.T).astype("<i4").tobytes()]),
                        pa.array([[r["scores"] for r in own]], pa.list_(pa.list_(pa.int64())))],
                        ["block", "length", "ids", "labels", "values", "scores"])

    return anchors.mapInArrow(cut, f"{BLOCK}, scores array<array<long>>")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30,
                   most: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    ``rows`` has vec_id, embedding and label; ``is_anchor`` is a condition on vec_id. Rows with a null id, label or
    vector, or with a null or non-finite component, take no part; vectors meet only those of their own length. An
    anchor's positives are the first other rows of its label, its negatives the first rows of other labels whose score
    lies within ``least`` and ``most`` percent of the positive's. Higher scores come first, ties by smaller vec_id. A
    row with the anchor's own id is never its positive; other repeated rows count each. Of anchors with one id the
    smallest (label, vector) stands for all. A component of 65,536 or more in size is an error, as scores could leave
    64 bits. Other columns are ignored. Empty tables give no rows.
    """
    whole = written(integers(rows), "integers")
    anchors = written(whole.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row"))
                      .select("vec_id", "row.label", "row.q"), "anchors")
    blocks = written(_blocks(whole, ROWS), "blocks")
    first = written(positives_of(blocks, written(_blocks(anchors, ANCHORS), "anchor_blocks"), positives), "positives")
    scored = written(_scored_blocks(_with_scores(anchors, first)), "scored")
    second = negatives_of(blocks, scored, negatives, least, most)
    found = first.select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(second, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame, every: int = 7, classes: int = 10) -> DataFrame:
    """Labels moved on by one where vec_id is divisible by ``every``."""
    label, vec_id = F.col("label").cast("long"), F.col("vec_id").cast("long")
    return rows.select("vec_id", "embedding", F.when(vec_id % every == 0, (label + 1) % classes).otherwise(label).alias("label"))
