"""Silence splitting on event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_segments(
    df: DataFrame, keys: Sequence[str], time: str, level: str, threshold: float, gap: str, watermark: str | None = None
) -> DataFrame:
    """Active stretches separated by at least ``gap`` of silence, per key, in batch or stream."""
    active = df.filter(F.col(level) > threshold)
    source = active.withWatermark(time, watermark) if watermark else active
    out = source.groupBy(*keys, F.session_window(time, gap).alias("__w")).agg(
        F.count(F.lit(1)).alias("n_active"), F.max(time).alias("__last")
    )
    seconds = (F.unix_micros("__last") - F.unix_micros("__w.start")) / 1e6
    return out.select(*keys, F.col("__w.start").alias("segment_start"), "n_active", seconds.alias("active_seconds"))
