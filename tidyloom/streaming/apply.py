"""A fitted plan over a stream.

The states of a plan are literals and dimension tables, so the same
``PlanModel`` cleans batch and streaming rows alike. Row-changing steps are not
part of a fitted plan; duplicates are removed within a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidyloom.plans.model import PlanModel


def clean_stream(stream: DataFrame, model: PlanModel) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("clean_stream expects a streaming DataFrame")
    return model.transform(stream)


def dedup_stream(stream: DataFrame, event_time: str, delay: str, keys: list[str]) -> DataFrame:
    """Exact duplicates that arrive within ``delay`` of each other; state is bounded by it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def write_stream(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
