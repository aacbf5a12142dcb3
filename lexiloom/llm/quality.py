"""Quality classifier: naive Bayes support vectors.

Indicators of byte n-grams, and of words said twice or more in a row, are scaled by the classes' log-count ratios, counted over all labelled training rows
with map-side sums, and put to unit length. A linear hinge-loss model is fitted to a bounded sample of them by
dual coordinate descent; a sigmoid fitted to the margins of rows the model has not seen turns margins into
scores.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import crc_of, documents_of, slices, texts_of
from lexiloom.llm.ngram_features import buckets, sampled
from lexiloom.session import settled

ORDERS = (1, 2, 3, 4)
BITS = 16
REPEATS = 3
SMOOTHING = 1.0
SAMPLE_PER_LABEL = 3000  # bound on the rows the linear model and the sigmoid are fitted to
COST = 1.0
EPOCHS = 12
THRESHOLD = 0.3


def indicators(text: bytes) -> np.ndarray:
    """Numbers of the indicators a text has: hashed n-grams, and in the first REPEATS places runs of equal words."""
    seen = np.zeros(1 << BITS, bool)
    seen[buckets(text, ORDERS, BITS)] = True
    words = text.split()
    same = bytes(map(operator.eq, words, words[1:]))
    for k in range(REPEATS):
        seen[k] = b"\1" * (k + 1) in same
    return np.flatnonzero(seen)


@dataclass
class QualityModel:
    weights: np.ndarray  # of an indicator that is scaled but not yet put to unit length
    squares: np.ndarray  # squared log-count ratios, for the length
    bias: float
    slope: float
    offset: float

    def score(self, seen: np.ndarray) -> float:
        length = np.sqrt(self.squares[seen].sum())
        margin = (self.weights[seen].sum() / length if length > 0 else 0.0) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))


def bucket_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of label 0 and 1 hold each bucket, and how many rows there are of each label."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in slices(batches, "text"):
            for label, text in zip(batch.column("label").to_pylist(), texts_of(batch)):
                total[label, indicators(text)] += 1
                n[label] += 1
        met = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(met, -1)), pa.array(np.append(total[0, met], n[0])), pa.array(np.append(total[1, met], n[1]))],
            ["bucket", "zeros", "ones"])

    counted = (rows.select("text", "label").mapInArrow(count, "bucket long, zeros long, ones long")
               .groupBy("bucket").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow())
    held, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for bucket, *both in zip(*(counted[c].to_pylist() for c in ("bucket", "zeros", "ones"))):
        if bucket < 0:
            n[:] = both
        else:
            held[:, bucket] = both
    return held, n


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, width: int, cost: float = COST,
                 epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) of the hinge-loss model by dual coordinate descent over rows of unit length."""
    rng, w, alpha = np.random.default_rng(7), np.zeros(width + 1), np.zeros(len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + w[width]) - 1.0
            new = min(max(alpha[i] - gradient / (values[i] @ values[i] + 1.0), 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                w[width] += step
                alpha[i] = new
    return w


def sigmoid(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic fit of labels 0/1 to margins, by damped Newton steps."""
    n = np.array([(weight * (1 - y)).sum(), (weight * y).sum()])
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    a, b = 1.0, float(np.log((n[1] + 1) / (n[0] + 1)))
    loss = lambda a, b: float((weight * (np.logaddexp(0, a * margins + b) - target * (a * margins + b))).sum())
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g, h = weight * (p - target), weight * p * (1 - p)
        hessian = np.array([[(h * margins ** 2).sum(), (h * margins).sum()], [(h * margins).sum(), h.sum()]])
        step = np.linalg.solve(hessian + 1e-9 * np.eye(2), [(g * margins).sum(), g.sum()])
        size = 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > loss(a, b):
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> QualityModel:
    """Model from rows of doc_id, text and label (0 or 1). With one label only, or none, every score is that
    label's share (0.5 without rows)."""
    held, n = bucket_counts(rows)
    if not n.all():
        zeros = np.zeros(1 << BITS)
        return QualityModel(zeros, zeros, 0.0, 0.0, 40.0 * float(np.sign(n[1] - n[0])))
    smooth = held + SMOOTHING
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            seen = [indicators(x).astype("<u2").tobytes() for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(seen, pa.binary())],
                                             ["doc_id", "label", "seen"])

    sample = (sampled(rows, "label", per_label).select("doc_id", "text", F.col("label").cast("int").alias("label"))
              .mapInArrow(features, "doc_id long, label int, seen binary").toArrow())
    sample = sample.sort_by([("doc_id", "ascending"), ("seen", "ascending")])  # the same model for any partitioning
    index = [np.frombuffer(x, "<u2").astype(np.int64) for x in sample["seen"].to_pylist()]
    y = sample["label"].to_numpy()
    values = [(lambda v: v / max(np.sqrt(v @ v), 1e-12))(ratio[x]) for x in index]
    apart = np.arange(len(index)) % 4 == 3  # margins of these rows, unseen by the model, give the sigmoid
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.ones(len(index), bool)
        learn = np.arange(len(index))
    else:
        learn = np.flatnonzero(~apart)
    w = dual_descent([index[i] for i in learn], [values[i] for i in learn], 2.0 * y[learn] - 1, 1 << BITS)
    margins = np.array([w[index[i]] @ values[i] + w[-1] for i in np.flatnonzero(apart)])
    seen_y = y[apart].astype(np.int64)
    weight = n[seen_y] / np.bincount(seen_y, minlength=2)[seen_y] / n.sum() * len(seen_y)
    slope, offset = sigmoid(margins, seen_y, weight)
    return QualityModel(w[:-1] * ratio, ratio ** 2, float(w[-1]), slope, offset)


def score(docs: DataFrame, model: QualityModel, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of its whole ``text``; nulls score as empty texts do, by the bias.

    Only texts go to Python and only scores come back; the other columns stay where they are.
    """
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([texts], ["text"])
        return pa.array([model.score(indicators(x)) for batch in slices([rows], "text") for x in texts_of(batch)], pa.float64())

    return docs.withColumn(out, scored(F.col("text").cast("string")))


def held_out(doc_id: Column) -> Column:
    return crc_of(doc_id) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows: doc_id, text, label of documents that are labelled 0 or 1 and not held out.

    Labels of a doc_id that is labelled more than once are averaged; a tie counts as 1."""
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(F.col("quality").isin(0, 1))
             .filter(~held_out(F.col("doc_id"))).groupBy("doc_id")
             .agg((F.avg("quality") >= 0.5).cast("int").alias("label")))
    # settled() counts the marks and broadcasts them if they are small; else the texts meet them in a shuffle.
    return documents_of(docs).join(settled(marks), "doc_id")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts get the score of no n-gram at all. Repeated rows are scored each; an empty table gives
    an empty result; without usable labels all scores are 0.5."""
    model = fit(labelled(docs, labels))
    scored = score(documents_of(docs), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
