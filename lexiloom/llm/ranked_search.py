"""Ranked search over whole texts by best positions in impact lists.

The corpus is cut into shards of documents, each with one impact list per term (documents by falling impact) and the
same postings by document for direct access. For an item, all its lists are read a step further in turn; a document
met for the first time is looked up in every list, which gives its whole score and its position in each. A list's best
position is the end of its unbroken run of seen positions, whether read or looked up; what stands behind it has at
most the impact found there. Reading stops once the sum of those impacts is strictly below the k-th score, so that
ties at the k-th place are all seen. Each shard's best k go on to one ranking per item.

Shards are filled where the documents lie, so no posting is shuffled and a frequent term is spread over all shards.
Items are worked through in blocks of about ``TERMS_AT_ONCE`` terms, the only thing sent to every task. All
arithmetic but the logarithm is in 64-bit integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import documents_of, slices, texts_of, written

TERMS_AT_ONCE = 400_000  # of a block of items, with repeats
POSTINGS = 1 << 21  # of a shard, unless one document has more
STEP = 8  # first positions read of each list; every round reads twice as many
NO_ID = -(1 << 63)  # stands for a null id where rows are ordered

# Letters, digits and everything beyond ASCII make up terms; only A-Z are lower-cased.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Shard:
    """Impact lists of some documents, and the same postings in the order of documents."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        order = np.lexsort((docs, -impacts, terms))
        self.docs, self.impacts = docs[order], impacts[order]
        self.ends = np.searchsorted(terms[order], np.arange(n_terms + 1))
        back = np.lexsort((self.docs, terms[order]))
        self.sorted_docs = self.docs[back]
        self.positions = back  # place among the impact-ordered postings

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents, by number, with one of the k highest scores above 0, ties at the k-th place included."""
        lists = [(w, self.ends[t], self.ends[t + 1]) for t, w in zip(terms.tolist(), weights.tolist())
                 if w > 0 and self.ends[t + 1] > self.ends[t]]
        lists = [(w, self.impacts[a:b], self.docs[a:b], self.sorted_docs[a:b], self.positions[a:b] - a, np.zeros(b - a + 1, bool))
                 for w, a, b in lists]
        known = np.zeros(0, np.int64)  # documents met, ascending
        scores = np.zeros(0, np.int64)
        best = [0] * len(lists)  # seen positions without a gap
        depth, step = 0, STEP
        while lists:
            new = np.unique(np.concatenate([x[2][depth:depth + step] for x in lists]))
            at = np.searchsorted(known, new)
            met = np.zeros(len(new), bool)
            inside = at < len(known)
            met[inside] = known[at[inside]] == new[inside]
            new = new[~met]
            own = np.zeros(len(new), np.int64)
            limit = 0
            for i, (w, impacts, _, by_doc, places, seen) in enumerate(lists):
                where = np.minimum(np.searchsorted(by_doc, new), len(by_doc) - 1)
                hit = by_doc[where] == new
                place = places[where[hit]]
                own[hit] += w * impacts[place]
                seen[place] = True
                best[i] += int(np.argmin(seen[best[i]:]))  # the last place is never seen
                if best[i] < len(impacts):
                    # Position 0 is always read, so a best position stands before the gap.
                    limit += w * int(impacts[best[i] - 1])
            at = np.searchsorted(known, new)
            known, scores = np.insert(known, at, new), np.insert(scores, at, own)
            depth, step = depth + step, 2 * step
            if limit == 0 or len(scores) >= k and limit < np.partition(scores, len(scores) - k)[-k]:
                break
        least = np.partition(scores, len(scores) - k)[-k] if len(scores) > k else 0
        kept = (scores > 0) & (scores >= least)
        return known[kept], scores[kept]


def _items(items: DataFrame) -> DataFrame:
    """(item_id, terms, uses): each item's different terms and how often it has them; one text per id."""
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    texts = texts.groupBy("item_id").agg(F.min("text").alias("text"))

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices([b], "text")):
            found = [Counter(terms_of(t)) for t in texts_of(batch)]
            yield pa.RecordBatch.from_pydict({
                "item_id": batch.column("item_id"), "terms": pa.array([list(c) for c in found], pa.list_(pa.binary())),
                "uses": pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))})

    return texts.mapInArrow(split, "item_id long, terms array<binary>, uses array<long>")


def _postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): the document's number of terms, and its counts of the terms that have a number."""
    width = len(numbers)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = numbers.get
        for batch in slices(batches, "text"):
            words = [terms_of(t) for t in texts_of(batch)]
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ids = np.fromiter((get(w, -1) for x in words for w in x), np.int64, int(lengths.sum()))
            keys, counts = np.unique((np.repeat(np.arange(len(words)), lengths) * width + ids)[ids >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(keys, np.arange(len(words) + 1) * width).astype(np.int32))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array(lengths),
                "terms": pa.ListArray.from_arrays(offsets, pa.array((keys % max(width, 1)).astype(np.int32))),
                "counts": pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))})

    return docs.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<long>")


def _document_counts(postings: DataFrame, width: int) -> np.ndarray:
    """In how many documents each numbered term stands."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=width)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some), "df": pa.array(total[some])})

    sums = postings.select("terms").mapInArrow(add, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    found = np.zeros(width, np.int64)
    for r in sums.toLocalIterator():
        found[r["term"]] = r["df"]
    return found


def weights_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def _best(postings: DataFrame, block: list, numbers: dict[bytes, int], weights: np.ndarray, n_docs: int, n_all: int,
          k: int) -> DataFrame:
    """(item_id, doc_id, score): of each shard the best k and ties with the k-th."""
    queries = []
    for r in block:
        ids = np.array([numbers[bytes(t)] for t in r["terms"]], np.int64)
        queries.append((r["item_id"], ids, weights[ids] * np.array(r["uses"], np.int64)))

    def search(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        n = table.column("n").to_numpy()
        counts = table.column("counts").combine_chunks()
        sizes = np.diff(counts.offsets.to_numpy())
        rows = np.repeat(np.arange(len(n)), sizes)
        tf = counts.flatten().to_numpy()
        terms = table.column("terms").combine_chunks().flatten().to_numpy().astype(np.int64)
        m = 100 - 25 + (25 * n * n_docs) // max(n_all, 1)
        shard = Shard(rows, terms, (1_000_000_000 * tf) // (1000 * tf + 12 * m[rows]), len(weights))
        items, found, scores = [], [], []
        for item_id, ids, own in queries:
            docs, points = shard.top(ids, own, k)
            items += [item_id] * len(docs)
            found.append(docs)
            scores.append(points)
        rows = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(items, pa.int64()), table.column("doc_id").combine_chunks().take(pa.array(rows)),
            pa.array(np.concatenate(scores) if scores else np.zeros(0, np.int64))], ["item_id", "doc_id", "score"])

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= POSTINGS:
                yield search(held)
                held, size = [], 0
        if held:
            yield search(held)

    return postings.mapInArrow(shards, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0.

    Every row of ``docs`` is a document; a null text has no terms and is not counted. Equal scores are ranked by
    ascending doc_id, null ids first; repeated rows rank one after the other. Items with a null text or without a term
    that some document holds have no rows. Of items with one id (a null id counts as an id) only the smallest text is
    searched. Other columns are ignored. Empty tables give no rows.
    """
    docs = documents_of(docs)
    queries = written(_items(items), "items")
    size = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = 1 + size // TERMS_AT_ONCE
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = None
    for b in range(blocks):
        block = queries.filter(block_of == b).collect()
        numbers = {t: i for i, t in enumerate(sorted({bytes(t) for r in block for t in r["terms"]}))}
        postings = written(_postings(docs, numbers), "postings")
        total = postings.filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        weights = weights_of(_document_counts(postings, len(numbers)), total["docs"])
        own = _best(postings, block, numbers, weights, total["docs"], total["terms"], k)
        found = own if found is None else found.unionAll(own)
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    # Shares of an item's rows are cut to k first, so that no task ranks what all shards sent.
    part = found.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(32)))
    first = part.withColumn("_r", F.row_number().over(Window.partitionBy("item_id", "_part").orderBy(*order))).filter(F.col("_r") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return first.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
