"""Byte-level BPE by a pair occurrence index, and its inverse.

The words a batch brings for the first time are merged together: an index maps each pair's rank to all
positions that hold the pair, active ranks are taken in ascending order, all positions of a rank are merged
from left to right, and only the lists of the neighbouring pairs are updated.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexiloom.llm.common import documents_of, slices, texts_of

CACHED_UNITS = 1_000_000

# The published split pattern of this vocabulary's family.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Runs between white space with the blank before them, and white space; splitting them further is the same
# as splitting the whole text, because no word spans two of them.
ASCII_UNITS = re.compile(rb" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
OTHER_SPACE = regex.compile(r"(?![\t-\r ])\s")
ALL_UNITS = regex.compile(r" ?\S+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[str, int]:
    """Letter to byte of the byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        vocabulary = spec["model"]["vocab"]
        self.single = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.single[byte] = vocabulary[letter]
        self.pairs, self.merged = {}, []
        self.first_ranks = np.full((256, 256), -1, np.int32)
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocabulary[left], vocabulary[right]] = rank
            self.merged.append((vocabulary[left], vocabulary[right], vocabulary[left + right]))
            if len(left) == len(right) == 1:
                self.first_ranks[letters[left], letters[right]] = rank
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pieces: list[bytes] = [b""] * (1 + max([*vocabulary.values(), *added.values()]))
        for text, number in vocabulary.items():
            if all(c in letters for c in text):
                self.pieces[number] = bytes(letters[c] for c in text)
        for text, number in added.items():
            self.pieces[number] = text.encode()
        self.decimal = list(map(str, range(len(self.pieces))))
        self.added = {text.encode(): np.array([number], "<u4").tobytes() for text, number in added.items()}
        self.special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") \
            if added else None
        self.known: dict[bytes, bytes] = {}

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. Every merge makes a new token, so a merge never brings back a lower rank."""
        pairs, merged = self.pairs, self.merged
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words))).tolist()
        following, previous = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        following[ends[ends > 0] - 1] = -1
        previous[[s for s, w in zip(starts, words) if w]] = -1
        symbols, after, before = self.single[data].tolist(), following.tolist(), previous.tolist()
        # The first entries of the index: positions grouped by the rank of the two bytes there.
        ranks = self.first_ranks[data[:-1], data[1:]] if len(data) else np.zeros(0, np.int32)
        ranks = np.where(following[:-1] < 0, -1, ranks)
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0):]
        active, firsts = np.unique(ranks[order], return_index=True)
        index = dict(zip(active.tolist(), (x.tolist() for x in np.split(order, firsts[1:]))))
        active = active.tolist()  # ascending, so already a heap
        find, push = pairs.get, heapq.heappush
        while active:
            rank = heapq.heappop(active)
            left, right, new = merged[rank]
            places = index.pop(rank)
            places.sort()
            for p in places:
                q = after[p]
                if q < 0 or symbols[p] != left or symbols[q] != right:
                    continue
                symbols[p], symbols[q] = new, -1
                after[p] = r = after[q]
                a = before[p]
                if a >= 0:
                    other = find((symbols[a], new))
                    if other is not None:
                        if other in index:
                            index[other].append(a)
                        else:
                            index[other] = [a]
                            push(active, other)
                if r >= 0:
                    before[r] = p
                    other = find((new, symbols[r]))
                    if other is not None:
                        if other in index:
                            index[other].append(p)
                        else:
                            index[other] = [p]
                            push(active, other)
        out = []
        for start, word in zip(starts, words):
            ids, p = [], start if word else -1
            while p >= 0:
                ids.append(symbols[p])
                p = after[p]
            out.append(ids)
        return out

    def _learn(self, units: list[bytes]) -> None:
        split = [[w.encode() for w in WORDS.findall(unit.decode())] for unit in units]
        words = list({w for parts in split for w in parts})
        ids = dict(zip(words, (array("I", x).tobytes() for x in self.merge(words))))
        for unit, parts in zip(units, split):
            self.known[unit] = b"".join([ids[w] for w in parts])

    def _units(self, text: bytes) -> list[bytes]:
        if not text.isascii() and OTHER_SPACE.search(string := text.decode()):
            return [x.encode() for x in ALL_UNITS.findall(string)]
        return ASCII_UNITS.findall(text)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text."""
        parts = []
        for text in texts:
            if self.special and self.special.search(text):
                parts.append([y for x in self.special.split(text) for y in ([x] if x in self.added else self._units(x))])
            else:
                parts.append(self._units(text))
        met = set().union(*parts)
        new = met.difference(self.known)
        if len(self.known) + len(new) > CACHED_UNITS:
            self.known = {x: self.known[x] for x in met if x in self.known}
        for token, ids in self.added.items():
            self.known[token] = ids
        new.difference_update(self.added)
        if new:
            self._learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in parts]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def pair_bpe(path: str) -> PairBpe:
    return PairBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str, digest_only: bool = False) -> DataFrame:
    """Ids of every whole text and the text they decode to: doc_id, ids (array), decoded; or only their digests
    doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``vocabulary`` is the path of a byte-level BPE file that every executor has. A null text counts as empty
    and has no ids. Rows never leave their partition; repeated rows are all kept, an empty table stays empty.
    """
    from hashlib import sha256

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = pair_bpe(vocabulary)
        for batch in slices(batches, "text"):
            counts, ids_sha, text_sha = [], [], []
            for raw in bpe.encode(texts_of(batch)):
                ids = np.frombuffer(raw, "<u4").tolist()
                counts.append(len(ids))
                ids_sha.append(sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = pair_bpe(vocabulary)
        for batch in slices(batches, "text"):
            ids = [np.frombuffer(raw, "<u4").tolist() for raw in bpe.encode(texts_of(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    rows = documents_of(docs)
    if digest_only:
        return rows.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return rows.mapInArrow(full, "doc_id long, ids array<int>, decoded string")
