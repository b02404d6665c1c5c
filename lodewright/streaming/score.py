"""Fitted steps on streams: a fitted transform is a projection, so it runs on a stream as it does on a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodewright.session import shared_dir


def transform_stream(stream: DataFrame, steps: Sequence) -> DataFrame:
    """Apply fitted steps (missing values, variance, univariate outliers, bins, scaling) in order."""
    for step in steps:
        stream = step.transform(stream)
    return stream


def drop_repeats(stream: DataFrame, keys: Sequence[str], time_col: str, delay: str = "1 hour") -> DataFrame:
    """First row of each key within the watermark."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))


def write_stream(stream: DataFrame, path: str, name: str) -> StreamingQuery:
    """Write what is there and stop; progress is kept in the shared folder."""
    place = f"{shared_dir(stream.sparkSession)}/streams/{name}"
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", place).trigger(availableNow=True).start()
