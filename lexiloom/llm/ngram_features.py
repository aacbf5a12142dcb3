"""Byte n-grams of whole texts in hashed buckets, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def buckets(text: bytes, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Bucket of every n-gram of the given orders (at most 8 bytes), by multiplicative hashing."""
    data = np.frombuffer(text, np.uint8)
    out, code = [], np.zeros(len(data), np.uint64)
    for n in range(1, max(orders) + 1):
        if len(data) < n:
            break
        code = (code[:len(data) - n + 1] << np.uint64(8)) | data[n - 1:].astype(np.uint64)
        if n in orders:
            out.append(((code + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def sampled(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label (all, where there are fewer): those with the smallest digest of
    their text and id. One pass counts the labels; nothing is ranked or collected."""
    counts = rows.groupBy(label).count().collect()  # one row for each label
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(label) == F.lit(r[label]), F.lit(min(1.0, per_label / r["count"]))).otherwise(share)
    return rows.filter(digest(F.col("doc_id"), F.col("text")) < share)


def digest(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)
