"""Window -> item -> (device, subdir) roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.config import HOT_GROUP_ROWS, METRICS, OPTIONAL_WINDOW_METRICS, POOLED, WINDOW_KEYS, WINDOW_METRICS
from hearken.functions.directions import feature_columns
from hearken.operators.quality import as_number, require_columns
from hearken.operators.skew import aggregate_with_quantiles


def pooled_mean_var(mean: Column, var: Column) -> tuple[Column, Column]:
    """Mean of means and total variance, from rows where both are present."""
    both = mean.isNotNull() & var.isNotNull()
    m, v = F.when(both, mean), F.when(both, F.greatest(var, F.lit(0.0)))
    center = F.avg(m)
    spread = F.avg(v + m * m) - center * center
    return center, F.when(spread.isNotNull(), F.greatest(spread, F.lit(0.0)))


def _std_or_zero(c: Column) -> Column:
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))


def windows_to_x(
    df: DataFrame,
    keys: Sequence[str] | None = None,
    optional: bool = False,
    limit: int | None = HOT_GROUP_ROWS,
) -> DataFrame:
    """One row per audio item with mean, median, std, min, max, range and pooled variance per metric.

    ``optional`` accepts tables without ``original_file`` and with extra variance columns.
    The standard deviation of a single window is 0 at this level.
    """
    if keys is None:
        keys = [*WINDOW_KEYS, *(["original_file"] if not optional or "original_file" in df.columns else [])]
    require_columns(df, [*keys, *WINDOW_METRICS])
    metrics = [*WINDOW_METRICS, *[c for c in OPTIONAL_WINDOW_METRICS if optional and c in df.columns]]
    extra = ["test_file"] if "test_file" in df.columns else []
    typed = df.select(*keys, *extra, *[as_number(F.col(c)).alias(c) for c in metrics])
    aggs = [F.count(F.lit(1)).alias("n_windows")]
    if extra:
        aggs.append(F.array_join(F.sort_array(F.collect_set("test_file")), "|").alias("test_files"))
    for c in metrics:
        v = F.col(c)
        aggs += [
            F.avg(v).alias(f"{c}_audio_mean"),
            _std_or_zero(v).alias(f"{c}_audio_std"),
            F.min(v).alias(f"{c}_audio_min"),
            F.max(v).alias(f"{c}_audio_max"),
            (F.max(v) - F.min(v)).alias(f"{c}_audio_range"),
        ]
    for prefix, mean, var in POOLED:
        if mean in metrics and var in metrics:
            pm, pv = pooled_mean_var(F.col(mean), F.col(var))
            aggs += [pm.alias(f"{prefix}_pooled_audio_mean"), pv.alias(f"{prefix}_pooled_audio_var")]
    return aggregate_with_quantiles(typed, keys, aggs, {f"{c}_audio_median": (c, 0.5) for c in metrics}, limit)


def x_to_device_subdir(
    df: DataFrame,
    features: Sequence[str] | None = None,
    keys: Sequence[str] = ("name", "subdir"),
    limit: int | None = HOT_GROUP_ROWS,
) -> DataFrame:
    """One row per (device, subdir): mean, median, spread and standard error of every item feature; NaN is missing."""
    require_columns(df, [*keys, "audio_index", "n_windows"])
    if features is None:
        features = feature_columns(df, [*keys, "audio_index", "original_file", "test_files", "n_windows"])
    aggs = [F.count(F.lit(1)).alias("n_audio"), F.sum("n_windows").alias("n_windows_total")]
    for c in features:
        v = F.col(c)
        std = _std_or_zero(v)
        aggs += [
            F.avg(v).alias(f"{c}_device_mean"),
            std.alias(f"{c}_between_audio_std"),
            F.when(F.count(v) > 0, std / F.sqrt(F.greatest(F.count(v), F.lit(1)))).alias(f"{c}_standard_error"),
        ]
    clean = df.withColumns({c: as_number(F.col(c)) for c in features})
    return aggregate_with_quantiles(clean, keys, aggs, {f"{c}_device_median": (c, 0.5) for c in features}, limit)


def windows_to_x_metrics(df: DataFrame) -> DataFrame:
    """Window table to the item-level table: window count, mean and sample variance per metric.

    An item with a single window has no sample variance; it gets 0.
    """
    source = {"kl": "kl_mean", "js": "js_mean", "l2": "l2", "cosim": "cos_sim"}
    aggs = [F.count(F.lit(1)).alias("n_windows")]
    for m in METRICS:
        v = as_number(F.col(source[m.key]))
        aggs += [F.avg(v).alias(m.mean), F.coalesce(F.var_samp(v), F.lit(0.0)).alias(m.var)]
    return df.withColumn("x", F.col("audio_index")).groupBy("name", "subdir", "x").agg(*aggs)
