"""Packing documents into fixed windows by order-preserving dynamic programming.

The ids of a partition's documents form one stream in the table's order. Windows are consecutive stretches
of it; they may be cut at document ends (free), at sentence ends (SENTENCE_PENALTY) and, where neither comes
for HARD_STEP ids, in between (HARD_PENALTY). A window pays its padding, WINDOW_PENALTY and the penalty of
its cut. With cuts at p_0 < p_1 < ... the least cost f satisfies, over i with p_j - p_i <= size,

    f_j = penalty_j + size - p_j + min(f_i + p_i),

whose minimum over a sliding range a monotone queue keeps, one push and one pop a cut. Windows whose length
is a power of two need no padding and are looked up by their exact starts.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lexiloom.llm.common import documents_of, slices, texts_of
from lexiloom.llm.tokens import END_ID, loaded, piece_encoder

WINDOW = 2048
SENTENCE_PENALTY = 4
HARD_PENALTY = 24
WINDOW_PENALTY = 32
HARD_STEP = 64
STREAM_TOKENS = 1 << 18
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


@lru_cache(maxsize=2)
def sentence_ids(vocabulary: str) -> np.ndarray:
    """For each id, whether its token is punctuation that ends a sentence."""
    known = loaded(vocabulary).get_vocab(with_added_tokens=True)
    ends = np.zeros(1 + max([*known.values(), END_ID]), bool)
    for token, number in known.items():
        text = token.removesuffix("</w>")
        ends[number] = any(c in ".!?" for c in text) and not any(c.isalnum() for c in text)
    return ends


def cuts(ids: np.ndarray, doc_ends: np.ndarray, enders: np.ndarray, step: int = HARD_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Where a window may end (0 first) and the penalty of each place."""
    penalty = np.full(len(ids) + 1, -1, np.int16)
    penalty[1:][enders[ids]] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    penalty[0] = 0
    places = np.flatnonzero(penalty >= 0)
    inner = (np.diff(places) - 1) // step  # places to add within each gap
    gap = np.repeat(np.arange(len(inner)), inner)
    number = np.arange(len(gap)) - np.repeat(np.cumsum(inner) - inner, inner) + 1
    penalty[places[gap] + step * number] = HARD_PENALTY
    places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


def best_windows(places: np.ndarray, penalties: np.ndarray, size: int = WINDOW) -> list[int]:
    """Ends of the windows of least total cost, by the recurrence above."""
    n = len(places)
    exact: dict[int, list[int]] = {}
    length = 1
    while length < size:
        at = np.searchsorted(places, places - length)
        for j in np.flatnonzero((at < n) & (places[np.minimum(at, n - 1)] == places - length)).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        length *= 2
    where, fines = places.tolist(), penalties.tolist()
    cost, came = [0] * n, [0] * n
    queue = deque([(0, 0)])  # (f_i + p_i, i), least in front
    for j in range(1, n):
        p = where[j]
        while where[queue[0][1]] < p - size:
            queue.popleft()
        key, i = queue[0]
        least = key + size - p
        for other in exact.get(j, ()):
            if cost[other] < least:
                least, i = cost[other], other
        cost[j] = least = least + fines[j] + WINDOW_PENALTY
        came[j] = i
        key = least + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    ends, j = [], n - 1
    while j:
        ends.append(where[j])
        j = came[j]
    return ends[::-1]


def pack(docs: DataFrame, vocabulary: str, size: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in windows of at most ``size`` ids (a power of two), and with ``with_ids`` their ids.

    A document's ids are those of its text and ``end_id``; a null or empty text is ``end_id`` alone. Rows stay in
    their partition and order, so nothing is shuffled; repeated rows are packed each; an empty table has no
    pieces. ``sequence_id`` joins the partition's number (high bits) and the window's number in it. A task holds
    about STREAM_TOKENS ids: all windows but the last of a stretch are given out and the rest is packed on.
    """
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enders = sentence_ids(vocabulary)
        end, base, windows = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 36, 0
        # Of each waiting document: id, its ids not given out yet, where these start in it, its length.
        waiting: list[list] = []

        def give(last: bool) -> pa.RecordBatch:
            nonlocal waiting, windows
            ids = np.concatenate([x[1] for x in waiting])
            doc_ends = np.cumsum([len(x[1]) for x in waiting])
            ends = best_windows(*cuts(ids, doc_ends, enders, min(HARD_STEP, size)), size)
            if not last:
                ends = ends[:-1]
            rows: list[tuple] = []
            document, at, begin = 0, 0, 0
            for stop in ends:
                while at < stop:
                    doc_id, own, start, total = waiting[document]
                    doc_end = int(doc_ends[document])
                    until = min(stop, doc_end)
                    piece = own[at - (doc_end - len(own)):until - (doc_end - len(own))].tobytes()
                    rows.append((doc_id, start + at - (doc_end - len(own)), until - at, zlib.crc32(piece), total,
                                 base + windows, at - begin, piece))
                    at = until
                    document += at == doc_end
                windows, begin = windows + 1, stop
            rest = waiting[document:]
            if rest and at > (head := int(doc_ends[document]) - len(rest[0][1])):
                doc_id, own, start, total = rest[0]
                rest[0] = [doc_id, own[at - head:], start + at - head, total]
            waiting = rest
            columns = list(zip(*rows)) or [()] * 8
            names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        held = 0
        with piece_encoder(vocabulary) as encoder:
            for batch in slices(batches, "text", 1 << 20):
                for doc_id, raw in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts_of(batch))):
                    ids = np.frombuffer(raw + end, "<u4")
                    waiting.append([doc_id, ids, 0, len(ids)])
                    held += len(ids)
                if held >= STREAM_TOKENS:
                    yield give(False)
                    held = sum(len(x[1]) for x in waiting)
        if waiting:
            yield give(True)

    if size & (size - 1):
        raise ValueError("the window must be a power of two")
    return documents_of(docs).mapInArrow(packed, PIECES + ", ids binary" * with_ids)
