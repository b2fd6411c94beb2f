"""Sliding metric windows as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_metrics(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], time: str = "ts",
    length: str = "5 seconds", step: str = "1 second", watermark: str | None = None,
) -> DataFrame:
    """Mean, sample variance and count per key and sliding event-time window.

    Works on a batch and on a stream; a stream needs a ``watermark``, after which a
    window is final and its state is dropped. The state per window is a few moments, never rows.
    """
    source = df.withWatermark(time, watermark) if watermark else df
    aggs = [F.count(F.lit(1)).alias("n_windows")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias(f"{v}_var")]
    out = source.groupBy(*keys, F.window(time, length, step).alias("__w")).agg(*aggs)
    return out.select(*keys, F.col("__w.start").alias("window_start"), *[c for c in out.columns if c not in (*keys, "__w")])
