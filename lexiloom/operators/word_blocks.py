"""Weights of words fitted on the same strings, in blocks of strings, so that no row of a word is ever shuffled.

The strings' words are counted where the strings lie and written as blocks: the words a block holds, once each, and for
every string their places among them and counts, as bytes. A block tells each of its words how many rows hold it there;
words of several blocks are added up by word and told back to their blocks, words of one block are known there. A block
then has all it needs to weigh and scale its strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.packing import pressed, unpressed, unzipped, zipped
from lexiloom.session import checked_in

BLOCK_ENTRIES = 1 << 20  # words of a block, counted with repeats
WORDS_PER_TASK = 1 << 19  # words of blocks that meet in a task
ROWS_AT_ONCE = 1 << 16
BLOCK = ("block long, keys array<string>, terms binary, lengths binary, owns binary, sizes binary, steps binary, counts binary, "
         "held binary, width long, mass long")
FIELDS = [x.split()[0] for x in BLOCK.split(", ")]


def _unzipped(cell: bytes) -> np.ndarray:
    return unzipped(cell).astype(np.int64)


def _strings(terms: bytes, lengths: bytes) -> pa.StringArray:
    """The words of a block from their bytes and lengths."""
    ends = np.append(0, np.cumsum(_unzipped(lengths))).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(unpressed(terms)))


def _block(number: int, keys: pa.Array, owns: np.ndarray, words: pa.ListArray) -> pa.RecordBatch:
    coded = words.flatten().cast(pa.string()).dictionary_encode()
    # In order, words compress well.
    order = pc.sort_indices(coded.dictionary)
    terms, rank = coded.dictionary.take(order), np.argsort(order.to_numpy())
    width = max(len(terms), 1)
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    cells = np.sort(np.repeat(np.arange(len(sizes)), sizes) * width + rank[coded.indices.to_numpy(zero_copy_only=False)])
    first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, np.int64)
    rows, places = np.divmod(cells[first], width)
    counts = np.diff(np.append(first, len(cells)))
    # A string's places rise, so that steps between them are small; its first place is a step from zero.
    steps = np.diff(places, prepend=0)
    new = np.append(True, rows[1:] != rows[:-1])[:len(rows)]
    steps[new] = places[new]
    held = np.zeros(width, np.int64)
    np.add.at(held, places, owns[rows])
    lengths = pc.binary_length(terms).to_numpy(zero_copy_only=False)
    raw = terms.buffers()[2]
    cells = [pressed(raw.to_pybytes()[:int(lengths.sum())] if raw else b"")] + [
        zipped(x) for x in (lengths, owns, np.bincount(rows, minlength=len(sizes)), steps, counts, held[:len(terms)])]
    names = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys.cast(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([number]), names, *(pa.array([x], pa.binary()) for x in cells),
                                       pa.array([len(terms)]), pa.array([int(owns.sum())])], FIELDS)


def packed(keys: DataFrame, words: Column) -> DataFrame:
    """The strings (key, count) in blocks, cut where they lie."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, entries = TaskContext.get().partitionId() << 32, [], 0

        def whole() -> pa.RecordBatch:
            names, owns, lists = zip(*held)
            return _block(number, pa.concat_arrays(names), np.concatenate(owns), pa.concat_arrays(lists))

        for batch in batches:
            ends = np.cumsum(batch.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            first = 0
            while first < batch.num_rows:
                before = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + BLOCK_ENTRIES - entries, "right")))
                some = batch.slice(first, last - first)
                held.append((some.column("key"), some.column("count").to_numpy(zero_copy_only=False).astype(np.int64), some.column("words")))
                entries, first = entries + int(ends[last - 1]) - before, last
                if entries >= BLOCK_ENTRIES or first < batch.num_rows:
                    yield whole()
                    number, held, entries = number + 1, [], 0
        if held:
            yield whole()

    return keys.select("key", "count", words.alias("words")).mapInArrow(pack, BLOCK)


def _told(blocks: DataFrame, parts: int) -> DataFrame:
    """(slice, places, totals): for each block, how many rows in all hold its words that other blocks hold too."""
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms, lengths, held = (batch.column(c)[i].as_py() for c in ("terms", "lengths", "held"))
                terms, held = _strings(terms, lengths), _unzipped(held)
                for at in range(0, len(terms), ROWS_AT_ONCE):
                    some = terms.slice(at, ROWS_AT_ONCE)
                    yield pa.RecordBatch.from_arrays(
                        [some, pa.array(np.full(len(some), batch.column("block")[i].as_py())),
                         pa.array(np.arange(at, at + len(some), dtype=np.int32)), pa.array(held[at:at + len(some)])],
                        ["term", "block", "place", "own"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        codes = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        block, place, own = (table[c].to_numpy() for c in ("block", "place", "own"))
        total = np.zeros(codes.max() + 1, np.int64)
        np.add.at(total, codes, own)
        several = np.flatnonzero(np.bincount(codes)[codes] > 1)
        several = several[np.argsort(block[several], kind="stable")]
        edges = np.flatnonzero(np.diff(block[several], prepend=-1, append=-1))
        for begin, end in zip(edges, edges[1:]):
            some = several[begin:end]
            yield pa.RecordBatch.from_arrays([pa.array([block[some[0]]]), *(pa.array([zipped(x)], pa.binary()) for x in (place[some], total[codes[some]]))],
                                             ["slice", "places", "totals"])

    rows = blocks.select("block", "terms", "lengths", "held").mapInArrow(tell, "term string, block long, place int, own long")
    return rows.repartition(parts, "term").mapInArrow(add, "slice long, places binary, totals binary")


def own_weights(keys: DataFrame, words: Column) -> DataFrame:
    """(key, term, value): count * (ln(n / df) + 1) of each string's words, scaled to unit length.

    ``keys`` holds distinct strings (key, count); n and df count rows.
    """
    blocks = checked_in(packed(keys, words), "words")
    total, told = blocks.agg(F.sum("mass"), F.sum("width")).first()
    parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(told or 0) // WORDS_PER_TASK))

    def weigh(rows: pa.Table, own: pa.Table) -> pa.Table:
        cell = lambda name: rows[name][0]
        sizes, steps, counts, held = (_unzipped(cell(c).as_py()) for c in ("sizes", "steps", "counts", "held"))
        for places, totals in zip(own["places"].to_pylist(), own["totals"].to_pylist()):
            held[_unzipped(places)] = _unzipped(totals)
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        before = np.append(0, np.cumsum(steps))[ends - sizes]
        places = np.cumsum(steps) - before[row]
        weights = counts * (np.log(total / held) + 1)[places]
        norm = np.sqrt(np.bincount(row, weights=weights * weights, minlength=len(sizes)))
        weights /= norm[row]
        names, terms = cell("keys").values, _strings(cell("terms").as_py(), cell("lengths").as_py())
        parts = [pa.RecordBatch.from_arrays([names.take(pa.array(row[i:i + ROWS_AT_ONCE])), terms.take(pa.array(places[i:i + ROWS_AT_ONCE])),
                                             pa.array(weights[i:i + ROWS_AT_ONCE])], schema) for i in range(0, len(row), ROWS_AT_ONCE)]
        return pa.Table.from_batches(parts, pa.schema([("key", pa.string()), ("term", pa.string()), ("value", pa.float64())]))

    schema = ["key", "term", "value"]
    # Strings without words are in no row.
    return (blocks.select("block", "keys", "terms", "lengths", "sizes", "steps", "counts", "held").groupBy("block")
            .cogroup(_told(blocks, parts).groupBy("slice")).applyInArrow(weigh, "key string, term string, value double"))
