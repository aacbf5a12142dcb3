"""Encoders on streams: stateless codes, static lookups and incremental topics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexiloom.operators.base import EncoderModel


def encode_stream(model: EncoderModel, stream: DataFrame) -> DataFrame:
    """Encode a stream with a fitted model.

    Row-local encoders and table lookups (a stream-static join, unseen strings taking
    the model's fallback or its error) need no state.
    """
    return model.transform(stream)
