"""The corpus pipeline: quality, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents`` and perhaps more, works on all
of its predecessor's rows, and returns the same columns (the last: pieces of packed windows). ``run`` writes every
stage's result to the shared folder and reads it back. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import language, near_duplicates, packing, quality, suffixes
from lexiloom.llm.common import table, written

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
NO_ID = near_duplicates.NO_ID


def _carried(docs: DataFrame) -> DataFrame:
    """The text, and all other columns in one that no operator's own columns can clash with."""
    return docs.select(F.col("text").cast("string").alias("text"),
                       F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def _restored(carried: DataFrame, docs: DataFrame) -> DataFrame:
    return carried.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. Empty texts are scored by the model's bias alone."""
    model = quality.fit(quality.labelled(docs, table(spark, sf_dir, "labels")))
    scored = quality.score(_carried(docs), model, "quality_score")
    return _restored(scored.filter(F.col("quality_score") >= quality.THRESHOLD), docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a centroid of some language. Texts without a letter, or null, go."""
    found = language.predict(_carried(docs), language.fit(language.training_rows(docs)))
    return _restored(found.filter(~F.col("rejected")), docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; of repeated rows, one."""
    found = near_duplicates.near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    kept = found.filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(key.alias("_key")).distinct()
    return (docs.withColumn("_key", key).join(kept, "_key", "left_semi").withColumn("_twin", F.xxhash64("text"))
            .dropDuplicates(["_key", "_twin"]).select(*(F.col(f"`{c}`") for c in docs.columns)))


def suffixes_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that also occur earlier."""
    return suffixes.cleaned(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicates_stage),
          ("suffixes", suffixes_stage), ("packing", packing_stage)]

# Models, signatures and token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
