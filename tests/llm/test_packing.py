"""Packing against exhaustive search and the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from conftest import EDGE, SMALL
from lexiloom.llm import packing
from lexiloom.llm.packing import WINDOW_PENALTY, best_windows, cuts
from lexiloom.llm.tokens import loaded

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def padding(length, size):
    return 0 if length & (length - 1) == 0 else size - length


def least_cost(places, penalties, size):
    best = [0] + [float("inf")] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            if places[j] - places[i] <= size:
                best[j] = min(best[j], best[i] + padding(places[j] - places[i], size) + penalties[j] + WINDOW_PENALTY)
    return best[-1]


@pytest.mark.parametrize("seed", range(40))
def test_windows_cost_least(seed):
    rng = np.random.default_rng(seed)
    places = np.append(0, np.cumsum(rng.integers(1, 30, rng.integers(1, 70))))
    penalties = rng.choice([0, 4, 24], len(places))
    ends, begin, cost, fine = best_windows(places, penalties, 64), 0, 0, dict(zip(places.tolist(), penalties.tolist()))
    for end in ends:
        assert end - begin <= 64
        cost += padding(end - begin, 64) + fine[end] + WINDOW_PENALTY
        begin = end
    assert begin == places[-1] and cost == least_cost(places.tolist(), penalties.tolist(), 64)


def test_cuts_are_near_each_other():
    ids = np.array([5] * 300 + [7] + [5] * 10)
    enders = np.zeros(10, bool)
    enders[7] = True
    places, penalties = cuts(ids, np.array([311]), enders)
    assert np.diff(places).max() <= packing.HARD_STEP
    assert penalties[places.tolist().index(301)] == packing.SENTENCE_PENALTY and penalties[-1] == 0


def check(rows, docs, size):
    tokenizer = loaded(VOCABULARY)
    windows, pieces = {}, {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for places in windows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= size
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            if r.start == 0:
                at = 0  # a repeated row begins anew
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        total = sum(r.length for r in pieces[doc_id])
        assert total == len(ids) * sum(d == doc_id for d, _ in docs)


@pytest.mark.parametrize("size", [2048, 32])
def test_edge_rows(edge, size):
    check(packing.pack(edge, VOCABULARY, size).collect(), EDGE, size)


def test_empty_table(nothing):
    assert packing.pack(nothing, VOCABULARY).count() == 0


def test_stream_is_cut_and_carried_on(spark, monkeypatch):
    monkeypatch.setattr(packing, "STREAM_TOKENS", 3000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.pack(docs, VOCABULARY).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    filled = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert sum(padding(n, 2048) for n in filled.values()) < 0.03 * sum(filled.values())
