"""32-bit MurmurHash3 over Arrow string arrays, and the UDFs built on it.

Spark's own ``hash`` treats the bytes after the last full word differently, so it
cannot stand in for the standard function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of the published 32-bit x86 variant.
C1, C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
M5, ADD = np.uint32(5), np.uint32(0xE6546B64)
F1, F2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _scramble(word: np.ndarray) -> np.ndarray:
    return _rotl(word * C1, 15) * C2


def byte_groups(values: pa.Array) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(positions, little-endian word matrix, byte length) for each byte length."""
    raw = values.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset: raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    groups = []
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        words = -(-int(size) // 4)
        packed = np.zeros((len(rows), words * 4), dtype=np.uint8)
        packed[:, : int(size)] = body[offsets[rows][:, None] + np.arange(int(size))]
        groups.append((rows, packed.view("<u4"), int(size)))
    return groups


def murmur3(groups, n: int, seed: int) -> np.ndarray:
    """Unsigned hash of each of the ``n`` strings that ``byte_groups`` laid out."""
    out = np.empty(n, dtype=np.uint32)
    for rows, words, size in groups:
        h = np.full(len(words), seed, dtype=np.uint32)
        for i in range(size // 4):
            h = _rotl(h ^ _scramble(words[:, i]), 13) * M5 + ADD
        if size % 4:
            h ^= _scramble(words[:, size // 4])
        h ^= np.uint32(size)
        h = (h ^ (h >> np.uint32(16))) * F1
        h = (h ^ (h >> np.uint32(13))) * F2
        out[rows] = h ^ (h >> np.uint32(16))
    return out


def gram_buckets(values: pa.Array, n_features: int) -> np.ndarray:
    """Feature-hashing bucket: absolute signed hash modulo the width."""
    hashed = murmur3(byte_groups(values), len(values), 0).astype(np.int32)
    return np.abs(hashed.astype(np.int64)) % n_features


# Bytes of text whose n-grams are laid out at once (more for a single longer text).
TEXT_BYTES = 1_000_000


def text_grams(texts: pa.Array, lo: int, hi: int, at_once: int = TEXT_BYTES) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray, int]]]]:
    """The character n-grams of some texts at a time: first text, one after the last, and groups by byte length.

    A group has the grams' texts (ascending, from 0), their words as ``murmur3`` takes them, and their byte length. Grams
    are cut out of the UTF-8 bytes in place, so that no list of short strings is ever made.
    """
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset: raw.offset + len(raw) + 1]
    body = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(raw):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + at_once, "right")) - 1)
        part = body[offsets[first]: offsets[last]]
        starts = np.flatnonzero((part & 0xC0) != 0x80)
        row = np.searchsorted(offsets[first + 1: last + 1] - offsets[first], starts, "right")
        starts = np.append(starts, len(part))
        groups = []
        for n in range(lo, hi + 1):
            whole = np.flatnonzero(row[n - 1:] == row[: max(len(row) - n + 1, 0)])
            sizes = starts[whole + n] - starts[whole]
            for size in np.unique(sizes):
                own = whole if len(sizes) and (sizes == size).all() else whole[sizes == size]
                packed = np.zeros((len(own), -(-int(size) // 4) * 4), dtype=np.uint8)
                for i in range(int(size)):
                    packed[:, i] = part[starts[own] + i]
                groups.append((row[own], packed.view("<u4"), int(size)))
        yield first, last, groups
        first = last


def distinct_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a group's words, and for each row the number of its own."""
    coded = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(4 * words.shape[1]), len(words), [None, pa.py_buffer(words)]).dictionary_encode()
    known = np.frombuffer(coded.dictionary.buffers()[1], dtype="<u4")[: len(coded.dictionary) * words.shape[1]]
    return known.reshape(-1, words.shape[1]), coded.indices.to_numpy()


def gram_totals(texts: pa.Array, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
    """(term, count): the n-grams of all texts and how often they occur, added up by part."""
    for _, _, groups in text_grams(texts, lo, hi):
        for _, words, size in groups:
            known, codes = distinct_words(words)
            body = np.ascontiguousarray(known).view(np.uint8)[:, :size]
            offsets = np.arange(len(known) + 1, dtype=np.int32) * size
            terms = pa.StringArray.from_buffers(len(known), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body)))
            yield pa.RecordBatch.from_arrays([terms, pa.array(np.bincount(codes, minlength=len(known)))], ["term", "count"])


def minhash_text(text: Column, lo: int, hi: int, n_components: int, spare: list[str]) -> Column:
    """:func:`minhash_signature` of all n-grams of a string that is cut up here; each distinct gram of a part is hashed once."""

    @F.arrow_udf("array<double>")
    def signature(texts: pa.Array) -> pa.Array:
        spared = byte_groups(pa.array(spare))
        alone = np.array([murmur3(spared, len(spare), seed).min() for seed in range(n_components)], dtype=float)
        out = np.full((len(texts), n_components), np.inf)
        for first, last, groups in text_grams(texts, lo, hi):
            own = out[first:last]
            for row, words, size in groups:
                known, codes = distinct_words(words)
                full = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                for seed in range(n_components):
                    hashed = murmur3([(np.arange(len(known)), known, size)], len(known), seed)
                    own[row[full], seed] = np.minimum(own[row[full], seed], np.minimum.reduceat(hashed[codes], full))
        out = np.where(np.isinf(out), alone, out) / (2**32 - 1)
        offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * n_components, type=pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return signature(text)


def minhash_signature(grams: Column, n_components: int, spare: list[str] | None = None) -> Column:
    """Minimum of each seeded hash over a gram list, scaled to [0, 1].

    ``spare`` are the grams an empty list stands for.

    Row-local, so it runs unchanged on a stream. Each distinct gram of a batch is
    hashed once per seed.
    """

    @F.arrow_udf("array<double>")
    def signature(lists: pa.Array) -> pa.Array:
        n = len(lists)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        sizes = lists.value_lengths().to_numpy()
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        groups = byte_groups(coded.dictionary)
        spared = byte_groups(pa.array(spare or [""]))
        out = np.empty((n, n_components))
        for seed in range(n_components):
            out[:, seed] = murmur3(spared, len(spare or [""]), seed).min()
            if len(full):
                hashed = murmur3(groups, len(coded.dictionary), seed)
                out[full, seed] = np.minimum.reduceat(hashed[codes], starts)
        out /= 2**32 - 1
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * n_components, type=pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return signature(grams)
