"""Static range asymmetric numeral systems for token ids.

Arithmetic of one block: ids are dealt over LANES interleaved states of 64 bits in [2^31, 2^63), each id
shrinks or grows its lane by its share of 2^SCALE_BITS, and lanes that would overflow give off 32-bit words.
Encoding runs from the last row of ids to the first, so decoding reads everything forward. Every
CHECKPOINT_ROWS rows the states and the word position are kept, so a reader may start there.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE_BITS = 20
LANES = 1024
CHECKPOINT_ROWS = 128
LOW = np.uint64(1 << 31)
HEADER = struct.Struct("<4sIQIIII")
MAGIC = b"RNS1"


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts of ids scaled to sum to 2^SCALE_BITS; each id that occurs keeps at least 1."""
    size = 1 << SCALE_BITS
    present = np.flatnonzero(counts)
    if len(present) > size:
        raise ValueError(f"more than {size} different ids")
    out = np.zeros(len(counts), np.int64)
    if not len(present):
        return out
    exact = counts[present] / counts.sum() * (size - len(present))
    share = 1 + np.floor(exact).astype(np.int64)
    most = np.argsort(-(exact - np.floor(exact)), kind="stable")[:size - share.sum()]
    share[most] += 1
    out[present] = share
    return out


class Model:
    """A shared frequency table with what the coder looks up."""

    def __init__(self, frequencies: np.ndarray):
        self.frequency = frequencies.astype(np.uint64)
        ends = np.cumsum(frequencies)
        self.start = (ends - frequencies).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.int32), frequencies)
        self.filler = int(np.argmax(frequencies)) if len(frequencies) else 0

    def encode(self, ids: np.ndarray) -> bytes:
        """One block: header, checkpoints, words and a checksum of all of them."""
        rows = -(-len(ids) // LANES)
        grid = np.full(rows * LANES, self.filler, np.int64)
        grid[:len(ids)] = ids
        grid = grid.reshape(rows, LANES)
        state, words, marks, given = np.full(LANES, LOW, np.uint64), [], [], 0
        bits, low32, half, one = np.uint64(SCALE_BITS), np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(1)
        shares, starts = self.frequency.take(grid), self.start.take(grid)
        limits = shares << np.uint64(63 - SCALE_BITS)
        for row in range(rows - 1, -1, -1):
            f = shares[row]
            full = np.flatnonzero(state >= limits[row])
            if len(full):
                out = state.take(full)
                words.append((out & low32).astype("<u4"))
                given += len(out)
                state[full] = out >> half
            whole = state // f
            # The state is whole * f and a rest, and becomes (whole << bits) + rest + start.
            state += whole * ((one << bits) - f) + starts[row]
            if row % CHECKPOINT_ROWS == 0:
                marks.append((given, state.copy()))
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        parts = [HEADER.pack(MAGIC, SCALE_BITS, len(ids), LANES, CHECKPOINT_ROWS, len(marks), len(stream))]
        for behind, kept in marks[::-1]:
            parts += [struct.pack("<I", len(stream) - behind), kept.astype("<u8").tobytes()]
        body = b"".join([*parts, stream.tobytes()])
        return body + struct.pack("<I", zlib.crc32(body))

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of a block, or of its checkpoints from ``first`` up to ``last`` only; a damaged block raises."""
        if len(block) < HEADER.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("block checksum does not match")
        magic, scale_bits, count, lanes, apart, marks, n_words = HEADER.unpack_from(block)
        if magic != MAGIC or scale_bits != SCALE_BITS:
            raise ValueError("not a block of this format")
        rows = -(-count // lanes)
        begin, end = first * apart, rows if last is None else min(rows, last * apart)
        if first >= marks or begin >= end:
            return np.zeros(0, np.uint32)
        size = 4 + 8 * lanes
        at = HEADER.size + first * size
        word, = struct.unpack_from("<I", block, at)
        state = np.frombuffer(block, "<u8", lanes, at + 4).astype(np.uint64)
        stream = np.frombuffer(block, "<u4", n_words, HEADER.size + marks * size).astype(np.uint64)
        out = np.empty((end - begin, lanes), np.int32)
        bits, mask, half = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1), np.uint64(32)
        for row in range(end - begin):
            slot = state & mask
            symbols = self.symbol.take(slot.view(np.int64), out=out[row], mode="wrap")
            state >>= bits
            state *= self.frequency.take(symbols)
            state += slot - self.start.take(symbols)
            short = np.flatnonzero(state < LOW)
            if need := len(short):
                state[short] = (state.take(short) << half) | stream[word:word + need]
                word += need
        return out.reshape(-1)[:min(count, end * lanes) - begin * lanes].view(np.uint32)
