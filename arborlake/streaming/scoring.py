"""Scoring of streams: prediction has no state, so a stream is scored as a table is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from arborlake.operators.forest import ForestModel


def score_stream(model: ForestModel, stream: DataFrame, path: str, checkpoint: str, *, proba: bool = False, available_now: bool = True) -> StreamingQuery:
    """Writes predictions of a stream as Parquet, each input row once; the checkpoint survives restarts."""
    writer = model.transform(stream, proba=proba).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).outputMode("append").start(path)
