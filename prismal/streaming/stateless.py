"""Operations on streams: those without state as they are, bins of time with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dataset import FDataset


def as_function(stream: DataFrame, domain: list[str], range: list[str], id: str = "stream") -> FDataset:
    """Selections (not the nearest one), index strides, uncurry, composition, and substitution by a static table or a formula run on it unchanged."""
    return FDataset(stream, domain, range, id)


def binned(stream: DataFrame, time: str, width: str, late: str, aggs: dict[str, Column], by: list[str] | None = None) -> FDataset:
    """Group by bin on a time coordinate: tumbling windows, which close after the watermark."""
    if dict(stream.dtypes)[time] == "timestamp_ntz":
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))  # watermarks ask for instants; the session's zone is taken
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width), *(by or [])).agg(*[a.alias(n) for n, a in aggs.items()])
    start = F.col("window.start").alias(time)
    return FDataset(grouped.select(start, *(by or []), *aggs), [time, *(by or [])], list(aggs), "binned")
