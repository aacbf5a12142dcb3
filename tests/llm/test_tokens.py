"""Token ids, BPE and coded files against the tokenizers library and exact round trips."""

import random
import unicodedata
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from conftest import EDGE, SMALL
from lexiloom.llm import pair_bpe, rans, token_files, tokens
from lexiloom.session import scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(4)
    return [t or "" for _, t in EDGE] + ["a \u00a0b\u2003 c", "\x1c\x1d a\x85b", "x \n y  z ", "don't we'LL 'S", "ΣΑΣ İ ſ ﬁ",
            "a<|endoftext|> b <|startoftext|>"] + [
        "".join(rng.choice("ab \n\t 'sé.😀\u00a0\x1f\u0301") for _ in range(rng.randrange(60))) for _ in range(500)]


@pytest.mark.parametrize("path, maker", [(WORDS, tokens.PieceEncoder), (BYTES, pair_bpe.PairBpe)])
def test_ids_equal_the_library(path, maker):
    texts = odd_texts()
    want = [x.ids for x in tokens.loaded(path).encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in maker(path).encode([t.encode() for t in texts])]
    assert got == want


def marked_letters():
    """Letters that the normalizer turns into a letter and a combining mark, and what may stand around them."""
    return [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c.isalpha()
            and not unicodedata.normalize("NFC", c).lower().isalpha()]


def test_marks_behind_combining_marks():
    rng = random.Random(8)
    letters = marked_letters()
    scripts = [chr(c) for c in (0x41, 0x61, 0x131, 0x130, 0xDF, 0x3A3, 0x416, 0x5D0, 0x627, 0x915, 0x93C, 0xE01, 0x4E2D, 0xAC00, 0x1F600, 0x301)]
    texts = ["CUMHURİYETİ. TÜRKİYE CUMHURİYETİ.", "BELEDİYESİ, İSTANBUL", "\u0958. \ufb2a,", *(f"x{c}. {c}, {c}a!" for c in letters)]
    texts += ["".join(rng.choice([*scripts, *letters[:40], *".,;:!? \n-0½²"]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    want = [x.ids for x in tokens.loaded(WORDS).encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.PieceEncoder(WORDS).encode([t.encode() for t in texts])]
    assert got == want


def test_case_before_combining_marks():
    """T and a diaeresis have no common letter, but t and a diaeresis have: case goes after the normal form."""
    texts = ["T\u0308 H\u0331 W\u030a Y\u030a J\u030c A\u0301", "WORD T\u0308. WORD", "XT\u0344", "t\u0308 Word"]
    want = [x.ids for x in tokens.loaded(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.PieceEncoder(WORDS).encode([t.encode() for t in texts])] == want


def test_signs_behind_letters():
    """Signs are parted from the letters before them, so that a word is learnt once whatever stands behind it."""
    rng = random.Random(11)
    parts = [*map(chr, range(128)), *"éİßﬁ\u0301\u0338\u0308½²日😀\u00a0\u2003", *["a", "s", "T", "'"] * 8, "<|endoftext|>",
             "<|startoftext|>", "<|", "|>", "don't", "we'LL", "x's", "'re", "$$$", "%%%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(6000)]
    want = [x.ids for x in tokens.loaded(WORDS).encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.PieceEncoder(WORDS).encode([t.encode() for t in texts])]
    assert got == want
    encoder, signs = tokens.PieceEncoder(WORDS), ["", ".", "$$$", "%%%", ",!!", "***"]
    words = [a + b + c for a in "abcdef" for b in "ghijklé" for c in "mnopé"]
    texts = [f"{w}{x} {w.upper()}{x}" for w in words for x in signs]
    want = [x.ids for x in tokens.loaded(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])] == want
    assert len(encoder.words) <= 2 * len(words) and len(encoder.others) <= len(signs)


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PIECES", 5)
    monkeypatch.setattr(pair_bpe, "CACHED_UNITS", 5)
    for path, encoder in ((WORDS, tokens.PieceEncoder(WORDS)), (BYTES, pair_bpe.PairBpe(BYTES))):
        for text in odd_texts()[:60]:
            ids = tokens.loaded(path).encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == ids


def test_decoding():
    bpe, library = pair_bpe.pair_bpe(BYTES), tokens.loaded(BYTES)
    rng = np.random.default_rng(3)
    for _ in range(200):
        ids = rng.integers(0, 50257, rng.integers(0, 12)).tolist()
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_documents(edge, nothing):
    rows = pair_bpe.encode_documents(edge, BYTES, digest_only=True).collect()
    library, seen = tokens.loaded(BYTES), {r.doc_id: r for r in rows}
    assert len(rows) == len(EDGE)
    for doc_id, text in EDGE:
        ids, row = library.encode(text or "", add_special_tokens=False).ids, seen[doc_id]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == sha256((text or "").encode()).hexdigest()
    full = {r.doc_id: r for r in pair_bpe.encode_documents(edge, BYTES).collect()}
    assert full[5].decoded == "One two three." and len(full[5].ids) == seen[5].n_tokens
    assert pair_bpe.encode_documents(nothing, BYTES).count() == 0


def test_blocks():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.3, 300_001) % 49_000).astype(np.uint32)
    model = rans.Model(rans.scaled(np.bincount(ids)))
    block = model.encode(ids)
    assert (model.decode(block) == ids).all()
    step = rans.CHECKPOINT_ROWS * rans.LANES
    assert (model.decode(block, 1, 2) == ids[step:2 * step]).all() and (model.decode(block, 2) == ids[2 * step:]).all()
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert len(block) * 8 < 1.1 * len(ids) * -(share * np.log2(share)).sum()
    for n in (0, 1, 511, 512, 513):
        assert (model.decode(model.encode(ids[:n])) == ids[:n]).all()
    broken = bytearray(block)
    broken[len(block) // 2] ^= 1
    with pytest.raises(ValueError):
        model.decode(bytes(broken))


def test_one_id_only():
    model = rans.Model(rans.scaled(np.array([0, 9])))
    ids = np.ones(2000, np.uint32)
    assert (model.decode(model.encode(ids)) == ids).all()


def test_frequencies_are_counted_by_batch(spark, edge, monkeypatch):
    """One count for each batch of rows, not for each document, whose array would be as long as the vocabulary."""
    stored = token_files.tokenized(edge, WORDS).collect()
    assert {r.width for r in stored} == {2}
    batch = pa.RecordBatch.from_pydict({"ids": [bytes(r.ids) for r in stored], "width": [r.width for r in stored]})
    calls, plain = [], np.bincount

    class Tokens:
        """Holds what the counting task is given."""
        def select(self, *names):
            return self

        def mapInArrow(self, count, schema):
            monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or plain(*a, **k))
            (self.counted,) = count(iter([batch, batch.slice(2, 3), batch.slice(0, 0)]))
            monkeypatch.setattr(np, "bincount", plain)
            return spark.createDataFrame([], "id long, n long")
    held = Tokens()
    token_files.frequencies(held)
    want = plain(np.concatenate([np.frombuffer(r.ids, "<u2") for r in [*stored, *stored[2:5]]]))
    assert len(calls) <= 3
    assert dict(zip(held.counted["id"].to_pylist(), held.counted["n"].to_pylist())) == {
        i: n for i, n in enumerate(want.tolist()) if n}


def test_files(spark, edge, nothing, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 5000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.union(edge.select("doc_id", "text").filter("doc_id is null or doc_id < 0"))
    path = scratch_path(spark, "corpus-test")
    token_files.write_corpus(docs, WORDS, path)
    got = sorted(token_files.read_corpus(spark, path).collect(), key=lambda r: r.start)
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    at, library = 0, tokens.loaded(WORDS)
    assert len(got) == len(texts)
    for row, (doc_id, text) in zip(got, texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row.doc_id, row.start, np.frombuffer(row.ids, "<u4").tolist()) == (doc_id, at, ids)
        at += len(ids)
    empty = scratch_path(spark, "corpus-test")
    token_files.write_corpus(nothing, WORDS, empty)
    assert token_files.read_corpus(spark, empty).count() == 0


def test_kept_pieces_are_bounded(monkeypatch):
    """Full caches make room by generations, and ids stay those of the library."""
    monkeypatch.setattr(tokens, "CACHED_PIECES", 400)
    encoder = tokens.PieceEncoder(WORDS)
    for k in range(20):
        texts = [f"the common word {' '.join(f'word{i}x, q{i}' for i in range(30 * k, 30 * k + 30))}."]
        got = encoder.encode([t.encode() for t in texts])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [
            x.ids for x in tokens.loaded(WORDS).encode_batch(texts, add_special_tokens=False)]
        assert len(encoder.words) + len(encoder.others) + sum(map(len, encoder.older)) <= 500
    assert any(encoder.older)
