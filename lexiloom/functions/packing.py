"""Numbers and bytes of a cell, compressed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def zipped(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes as the largest needs, and these compressed."""
    x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return bytes([x.itemsize]) + pressed(x.tobytes())


def unzipped(cell: bytes) -> np.ndarray:
    return np.frombuffer(unpressed(cell[1:]), f"<u{cell[0]}")


def pressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpressed(cell: bytes) -> bytes:
    return pa.decompress(cell[8:], int.from_bytes(cell[:8], "little"), codec="zstd", asbytes=True)
