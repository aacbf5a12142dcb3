"""Token ids by the tokenizers library, looked up per piece of text.

The vocabulary used here drops white space, ignores case and splits letters from punctuation before it merges, so
a text's ids are those of its pieces in order: what stands between ASCII white space, cut once more where a sign
follows an ASCII letter. A batch is cut at once by its bytes, and Arrow tells its different pieces; a piece of other
letters with signs behind is put together from its parts. Each Python worker keeps the ids of parts it
has met; those that are new reach the library, many in one call. Parts of letters alone end where a token does that
ends a word, and need none of the vocabulary's patterns; the others are parted by a marker that has an id of its own.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa

from lexiloom.llm.common import in_use, joined, left_over

END_ID = 1
MARK = "\x01"
CACHED_PIECES = 800_000  # in two generations
PIECES_PER_TEXT = 256
SIGNS = b"""!"#$%&()*+,-./:;<=>?@[\\]^_`{}~"""  # not ' and |, which stand within contractions and special tokens
SPACE, LETTER, SIGN = 1, 2, 3
# The kind of each byte; 0 is any other.
KINDS = bytes(SPACE if c in b" \t\n\v\f\r" else LETTER if bytes([c]).isalpha() else SIGN if c in SIGNS else 0
              for c in range(256))


@lru_cache(maxsize=4)
def loaded(path: str):
    """The tokenizer of a vocabulary file, without truncation or padding and with one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _letters(piece: bytes) -> bool:
    """Whether the piece is of letters alone once the vocabulary's normalizer (NFC, lower case) has seen it."""
    return piece.isalpha() or not piece.isascii() and unicodedata.normalize("NFC", piece.decode()).lower().isalpha()


def _lowered(text: bytes) -> bytes:
    """The text with ASCII letters in lower case, unless case counts: where a special token or a combining mark (U+0300
    to U+037F) may stand, as T and a diaeresis stay apart and t and a diaeresis become one letter."""
    return text if b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.lower()


def _bytes(pieces: pa.LargeBinaryArray) -> list[bytes]:
    """Each piece, cut from the array's buffer at once."""
    data = b"" if (held := pieces.buffers()[2]) is None else held.to_pybytes()
    bounds = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:pieces.offset + len(pieces) + 1].tolist()
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def cut(data: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The pieces of a text's bytes in order, and where each starts there."""
    kinds = np.frombuffer(data.tobytes().translate(KINDS), np.uint8)
    kept = kinds != SPACE
    begins = kept.copy()
    begins[1:] &= ~kept[:-1] | (kinds[1:] == SIGN) & (kinds[:-1] == LETTER)
    starts = np.flatnonzero(begins)
    body = data[kept]
    bounds = np.append(np.cumsum(kept)[starts] - 1, len(body))
    buffers = [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(body)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers), starts


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers; equal to encoding each text at once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = loaded(path)
        # The same merges for words of letters alone: nothing but white space parts them, and ASCII needs no normal form.
        self.of_ascii, self.of_letters = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.of_ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.of_letters.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.of_letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[bytes, bytes] = {}  # letters alone
        self.others: dict[bytes, bytes] = {}  # signs, and pieces of other kinds
        self.older: tuple[dict[bytes, bytes], dict[bytes, bytes]] = {}, {}  # both as they were when they got full
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Ask the library for what pieces lack."""
        words, others = set(), set()
        for piece in new:
            core = piece.rstrip(SIGNS)
            if core and _letters(core):
                words.add(core)
                others.add(piece[len(core):])
            else:
                others.add(piece)
        ask = self._unknown(self.words, self.older[0], words)
        for tokenizer, some in ((self.of_ascii, [x for x in ask if x.isascii()]),
                                (self.of_letters, [x for x in ask if not x.isascii()])):
            self._learn_groups(tokenizer, self.words, some, b" ", lambda ids: np.flatnonzero(self.ends_word[ids])[:-1] + 1, 0)
        self.others[b""] = b""
        ask = self._unknown(self.others, self.older[1], others)
        odd = [x for x in ask if b"\x01" in x]
        for piece, ids in zip(odd, self._ids(self.tokenizer, [x.decode() for x in odd])):
            self.others[piece] = ids.tobytes()
        plain = [x for x in ask if b"\x01" not in x]
        self._learn_groups(self.tokenizer, self.others, plain, f" {MARK} ".encode(),
                           lambda ids: np.flatnonzero(ids == self.mark), 1)

    @staticmethod
    def _unknown(known: dict[bytes, bytes], older: dict[bytes, bytes], pieces: set[bytes]) -> list[bytes]:
        """Those of the pieces that are new. What was known before the last change of generation is known again."""
        known.update((x, older[x]) for x in pieces if x in older)
        return [x for x in pieces if x not in known]

    def _learn_groups(self, tokenizer, known: dict[bytes, bytes], pieces: list[bytes], between: bytes, cuts_of, skip: int) -> None:
        """Ids of pieces that are encoded many at a time; at each cut, ``skip`` ids belong to no piece."""
        groups = [pieces[i:i + PIECES_PER_TEXT] for i in range(0, len(pieces), PIECES_PER_TEXT)]
        # Texts where case counts were not lowered, and the tokenizer of ASCII words leaves case as it is.
        texts = [(x.lower() if tokenizer is self.of_ascii else x).decode() for x in map(between.join, groups)]
        for group, ids in zip(groups, self._ids(tokenizer, texts)):
            cuts = cuts_of(ids)
            if len(cuts) != len(group) - 1:  # not as parted as expected: one by one
                for piece, own in zip(group, self._ids(self.tokenizer, [x.decode() for x in group])):
                    known[piece] = own.tobytes()
                continue
            data, cuts = ids.tobytes(), cuts.tolist()
            for piece, a, b in zip(group, [0, *(c + skip for c in cuts)], [*cuts, len(ids)]):
                known[piece] = data[4 * a:4 * b]

    def _found(self, piece: bytes) -> bytes | None:
        core = piece.rstrip(SIGNS)
        word = self.words.get(core)
        if word is None:
            return self.others.get(piece)
        marks = self.others.get(piece[len(core):])
        return None if marks is None else word + marks

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each of the different pieces."""
        words, others = self.words.get, self.others.get
        out = [words(x) or others(x) for x in pieces]
        lacking = [i for i, x in enumerate(out) if x is None]
        if len(self.words) + len(self.others) + len(lacking) > CACHED_PIECES // 2:
            self.older = self.words, self.others
            self.words, self.others = {}, {}
        older, new = self.older[0].get, []
        for i in lacking:
            if (word := older(pieces[i])) is not None:
                self.words[pieces[i]] = out[i] = word
            elif (found := self._found(pieces[i])) is not None:
                out[i] = found
            else:
                new.append(i)
        if new:
            self._learn([pieces[i] for i in new])
            words = self.words.get
            for i in new:
                out[i] = words(pieces[i]) or self._found(pieces[i])
        return out

    def flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's start (plus the end)."""
        data, begins = joined([_lowered(x) for x in texts], 1, b" ")
        pieces, starts = cut(data)
        coded = pieces.dictionary_encode()
        own = self._pieces(_bytes(coded.dictionary))
        sizes = np.fromiter(map(len, own), np.int64, len(own)) >> 2
        firsts = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        lengths = sizes[codes]
        ends = np.append(0, np.cumsum(lengths))
        # Where each id of the texts stands among the ids of the different pieces.
        at = np.arange(ends[-1]) + np.repeat(firsts[codes] - ends[:-1], lengths)
        return np.frombuffer(b"".join(own), "<u4")[at], ends[np.searchsorted(starts, begins)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        ids, bounds = self.flat(texts)
        raw, bounds = ids.tobytes(), (4 * bounds).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@contextmanager
def piece_encoder(path: str) -> Iterator[PieceEncoder]:
    """The worker's encoder, which later tasks of the same kind find again with all pieces it has met."""
    in_use("pieces")
    yield _encoder(path)
    left_over("pieces", _release)


def _release() -> None:
    _encoder.cache_clear()
    loaded.cache_clear()
