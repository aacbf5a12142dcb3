"""Language identification by nearest centroid.

A text's byte n-grams, hashed, weighted by log frequency and inverse document frequency and put to
unit length, are compared by cosine with several centroids per language, which spherical k-means finds in a
bounded sample. A text is rejected if its cosine with that language's centroids is under RELIEF times what almost all
sampled texts reach with centroids fitted without them; less is asked of short texts, whose few n-grams keep them away
from any centroid. Centroids of a few odd texts, such as texts of two languages, do not count for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import crc_of, documents_of, slices, texts_of
from lexiloom.llm.ngram_features import buckets, sampled

ORDERS = (1, 2, 3)
BITS = 13
SAMPLE_PER_LANGUAGE = 600  # bound on the texts the centroids are fitted to
CENTROIDS = 4
ROUNDS = 20
QUANTILE = 0.005
RELIEF = 0.9
SUPPORT = 0.02  # share of a language's sampled texts that a centroid must be nearest to, to count for rejection
UNKNOWN = "und"
TO_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
IDF_FLOOR = 0.5  # keeps a text of common n-grams from having no weight at all
HALF_LENGTH = 300  # n-grams at which the accepted cosine is sqrt(1/2) of that of long texts
LETTER = regex.compile(r"\p{L}")


def _letters(text: bytes) -> bytes:
    """Lower-cased text whose runs of ASCII characters other than letters are one blank each, with a blank around."""
    lowered = text.lower() if text.isascii() else text.decode().lower().encode()
    return b" " + b" ".join(lowered.translate(TO_BLANK).split()) + b" "


def _counts(text: bytes) -> np.ndarray:
    return np.bincount(buckets(_letters(text), ORDERS, BITS), minlength=1 << BITS)


@dataclass
class LanguageModel:
    languages: list[str]  # sorted
    idf: np.ndarray
    centroids: np.ndarray  # one row each, of unit length
    owner: np.ndarray  # which language a centroid belongs to
    firm: np.ndarray  # whether a centroid counts for rejection
    least: np.ndarray  # least cosine a language accepts

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts).astype(np.float32) * self.idf)

    def nearest(self, texts: list[bytes]) -> list[tuple[str | None, float, bool]]:
        """Language, cosine and whether it is rejected; without letters ``und``, 0 and True."""
        out: list[tuple[str | None, float, bool]] = []
        for begin in range(0, len(texts), 64):
            some = texts[begin:begin + 64]
            if not self.languages:
                out += [(UNKNOWN, 0.0, True)] * len(some)
                continue
            counts = np.stack([_counts(x) for x in some])
            cosines = self.vectors(counts) @ self.centroids.T
            grams = counts.sum(1)
            relief = _ease(grams)
            # Ties go to the first language in the sorted order.
            for text, row, best, ease in zip(some, cosines, cosines.argmax(1), relief):
                owner = int(self.owner[best])
                if LETTER.search(text.decode()):
                    close = min(max(float(row[best]), 0.0), 1.0)
                    firm = float(row[self.firm & (self.owner == owner)].max())
                    out.append((self.languages[owner], close, bool(firm < self.least[owner] * ease)))
                else:
                    out.append((UNKNOWN, 0.0, True))
        return out


def _ease(grams: np.ndarray) -> np.ndarray:
    return np.sqrt(grams / (grams + HALF_LENGTH))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def clustered(vectors: np.ndarray, k: int) -> np.ndarray:
    """Centroids of spherical k-means, begun with the farthest-first choice from the mean."""
    chosen, near = [], vectors @ _unit(vectors.mean(0, keepdims=True))[0]
    near = near.copy()
    for _ in range(min(k, len(vectors))):
        at = int(near.argmin())
        chosen.append(at)
        near = np.maximum(near, vectors @ vectors[at]) if len(chosen) > 1 else vectors @ vectors[at]
    centroids = vectors[chosen]
    for _ in range(ROUNDS):
        own = (vectors @ centroids.T).argmax(1)
        sums = np.stack([vectors[own == c].sum(0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = _unit(sums)
    return centroids


def supported(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Whether each centroid is nearest to enough texts; the one with most always is."""
    near = np.bincount((vectors @ centroids.T).argmax(1), minlength=len(centroids))
    return near >= min(SUPPORT * len(vectors), near.max())


def reached(vectors: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """What each text's cosine, without the ease of its length, is with centroids of the other half of the texts."""
    out = []
    for half in (0, 1):
        own, other = vectors[half::2], vectors[1 - half::2]
        if len(own) and len(other):
            centroids = clustered(other, CENTROIDS)
            out.append((own @ centroids[supported(other, centroids)].T).max(1) / _ease(np.maximum(grams[half::2], 1)))
    return np.concatenate(out) if out else np.zeros(0)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each bucket, over all rows, and how many texts there are."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in slices(batches, "text"):
            for text in texts_of(batch):
                total += _counts(text) > 0
                n += 1
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1)), pa.array(np.append(total[met], n))], ["bucket", "n"])

    counted = (rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
               .toArrow())
    seen = dict(zip(counted["bucket"].to_pylist(), counted["n"].to_pylist()))  # at most a row for each bucket
    out = np.zeros(1 << BITS, np.int64)
    out[[b for b in seen if b >= 0]] = [n for b, n in seen.items() if b >= 0]
    return out, seen.get(-1, 0)


def fit(rows: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Model from rows of doc_id, text and lang without nulls."""
    held, n = document_frequencies(rows)
    idf = (np.log((1 + n) / (1 + held)) + IDF_FLOOR).astype(np.float32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts = [_counts(x) for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"),
                 pa.array([np.flatnonzero(x).astype("<u2").tobytes() for x in counts], pa.binary()),
                 pa.array([x[x > 0].astype("<u4").tobytes() for x in counts], pa.binary())],
                ["doc_id", "lang", "at", "counts"])

    sample = (sampled(rows, "lang", per_language).select("doc_id", "text", "lang")
              .mapInArrow(features, "doc_id long, lang string, at binary, counts binary").toArrow()
              .sort_by([("doc_id", "ascending"), ("at", "ascending"), ("counts", "ascending")]))
    languages = sorted(set(sample["lang"].to_pylist()))
    model = LanguageModel(languages, idf, np.zeros((0, 1 << BITS), np.float32), np.zeros(0, int), np.zeros(0, bool), np.zeros(0))
    parts, owner, firm, reach = [], [], [], []
    for number, language in enumerate(languages):
        own = sample.filter(pc.equal(sample["lang"], language))
        vectors = np.zeros((own.num_rows, 1 << BITS), np.float32)
        for row, at, counts in zip(vectors, own["at"].to_pylist(), own["counts"].to_pylist()):
            row[np.frombuffer(at, "<u2")] = np.frombuffer(counts, "<u4")
        grams, vectors = vectors.sum(1), model.vectors(vectors)
        centroids = clustered(vectors, CENTROIDS)
        parts.append(centroids)
        owner += [number] * len(centroids)
        firm.append(supported(vectors, centroids))
        reach.append(reached(vectors, grams))
    if parts:
        # A language of few texts does not show what one in some hundred reaches; no more is asked than of all together.
        pooled = np.concatenate(reach)
        least = [RELIEF * float(min(np.quantile(x, QUANTILE) for x in (own, pooled) if len(x))) if len(pooled) else 0.0
                 for own in reach]
        model.firm = np.concatenate(firm)
        model.centroids = np.concatenate(parts).astype(np.float32)
        model.owner, model.least = np.array(owner), np.array(least)
    return model


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (cosine) and rejected, from the whole ``text``.

    Only texts go to Python; the other columns stay where they are.
    """
    names = ("lang_pred", "score", "rejected")

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def predicted(texts: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([texts], ["text"])
        found = [x for batch in slices([rows], "text") for x in model.nearest(texts_of(batch))]
        kinds = (pa.string(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], list(names))

    source = docs.drop(*names)
    found = source.withColumn("_found", predicted(F.col("text").cast("string")))
    return found.select(*(F.col(f"`{c}`") for c in source.columns), *(F.col(f"_found.{c}").alias(c) for c in names))


def held_out(doc_id: Column) -> Column:
    return crc_of(doc_id) % 4 == 2


def training_rows(docs: DataFrame) -> DataFrame:
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
            .filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document.

    A null text, or one without a letter, is ``und`` with score 0 and rejected. Repeated rows are predicted each;
    an empty table gives an empty result; without training rows every text is ``und``."""
    found = predict(documents_of(docs), fit(training_rows(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
