"""Sparse term vectors counted row by row, without exploding a string into rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.murmur import gram_buckets, murmur3, text_grams

VECTOR = "struct<indices:array<int>,values:array<double>>"
# Bytes of text whose n-grams are counted at once (more for a single longer text).
COUNTED_BYTES = 250_000


def term_vector(terms: Column, width: int, offset: int = 0, lookup: Broadcast | None = None) -> Column:
    """Struct of sorted ``indices`` and their counts for a list of terms per row.

    ``lookup`` holds (vocabulary in index order, weights or None); without it terms are
    hashed into ``width`` buckets. With weights, values are count * weight scaled to
    unit length. Terms outside the vocabulary are left out.
    """

    @F.arrow_udf(VECTOR)
    def count(lists: pa.Array) -> pa.Array:
        n = len(lists)
        coded = lists.flatten().dictionary_encode()
        weights = None
        if lookup is None:
            index = gram_buckets(coded.dictionary, width)
        else:
            vocabulary, weights = lookup.value
            found = pc.index_in(coded.dictionary, value_set=vocabulary)
            index = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        index = index[coded.indices.to_numpy(zero_copy_only=False)] if n else np.zeros(0, np.int64)
        row = np.repeat(np.arange(n), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
        known = index >= 0
        cells, counts = np.unique(row[known] * width + index[known], return_counts=True)
        row, index = cells // width, cells % width
        values = counts.astype(float)
        if weights is not None:
            values *= weights[index]
            norm = np.sqrt(np.bincount(row, weights=values * values, minlength=n))
            values /= norm[row]
        offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, pa.array((index + offset).astype(np.int32))),
             pa.ListArray.from_arrays(offsets, pa.array(values))], names=["indices", "values"])

    return count(terms)


def term_totals(terms: Column) -> Column:
    """A row's list of terms as (term, count), each term once, in no certain order."""

    @F.arrow_udf("array<struct<term:string,count:bigint>>")
    def total(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
        width = max(len(coded.dictionary), 1)
        cells, counts = np.unique(row * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        offsets = pa.array(np.searchsorted(cells // width, np.arange(len(lists) + 1)).astype(np.int32))
        pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(cells % width)), pa.array(counts)], names=["term", "count"])
        return pa.ListArray.from_arrays(offsets, pairs)

    return total(terms)


def gram_counts(texts: pa.Array, width: int, lo: int = 2, hi: int = 4) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The hashed n-grams of some texts at a time: first text, one after the last, how many buckets each has, buckets and counts."""
    for first, last, groups in text_grams(texts, lo, hi, COUNTED_BYTES):
        keys = [np.zeros(0, np.int64)]
        for row, words, size in groups:
            hashed = murmur3([(slice(None), words, size)], len(words), 0).astype(np.int32)
            keys.append(row * width + np.abs(hashed.astype(np.int64)) % width)
        keys = np.concatenate(keys)
        if (last - first) * width <= 4 * len(keys):
            dense = np.bincount(keys, minlength=(last - first) * width)
            cells = np.flatnonzero(dense)
            counts = dense[cells]
        else:
            cells, counts = np.unique(keys, return_counts=True)
        yield first, last, np.bincount(cells // width, minlength=last - first), (cells % width).astype(np.int32), counts.astype(float)


def gram_struct(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], offset: int = 0) -> pa.StructArray:
    """(how many, buckets, counts) of texts as sparse vectors."""
    sizes, indices, values = ([np.zeros(0, kind), *x] for kind, x in zip((np.int64, np.int32, float), zip(*parts) if parts else ([], [], [])))
    offsets = pa.array(np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int32))
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(indices) + np.int32(offset))),
         pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values)))], names=["indices", "values"])


def gram_vector(text: Column, width: int, lo: int = 2, hi: int = 4, offset: int = 0) -> Column:
    """:func:`term_vector` of the hashed n-grams of a string that is cut up here, part by part of a batch."""

    @F.arrow_udf(VECTOR)
    def count(texts: pa.Array) -> pa.Array:
        return gram_struct([x[2:] for x in gram_counts(texts, width, lo, hi)], offset)

    return count(text)


def side_by_side(vectors: list[Column]) -> Column:
    """Vectors over disjoint, rising index ranges as one."""
    if len(vectors) == 1:
        return vectors[0]
    return F.struct(F.concat(*[v["indices"] for v in vectors]).alias("indices"),
                    F.concat(*[v["values"] for v in vectors]).alias("values"))
