"""Normalised items to (device, subdir) with uncertainty, and stage-2 features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.config import HOT_GROUP_ROWS, METRICS
from hearken.functions.exprs import clip, join_warnings, total
from hearken.operators.skew import aggregate_with_quantiles, keyed_join


def reliability_weight(n_x: Column, coverage: Column) -> Column:
    count_part = F.sqrt(F.least(n_x, F.lit(3)) / 3.0)
    return clip(count_part * F.coalesce(F.sqrt(coverage), F.lit(0.5)), 0.25, 1.0)


def uncertainty_aggregates() -> tuple[list[Column], dict[str, tuple[str, float]]]:
    aggs = [F.count(F.lit(1)).alias("n_x"), F.sum("n_windows").cast("long").alias("n_windows_total")]
    wanted = {}
    for m in METRICS:
        q, se = F.col(f"{m.key}_quality"), F.col(f"{m.key}_within_se")
        aggs += [
            F.avg(q).alias(f"{m.key}_quality_mean"),
            F.stddev_samp(q).alias(f"{m.key}_between_x_std"),
            F.avg(se).alias(f"{m.key}_within_se_mean"),
            F.sum(se * se).alias(f"{m.key}__se2"),
        ]
        wanted[f"{m.key}_quality_median"] = (f"{m.key}_quality", 0.5)
    return aggs, wanted


def finish_uncertainty(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Derived columns of the (device, subdir) table from its raw aggregates.

    Needs n_x, n_unique_x, expected_x, n_windows_total, __fallback and the per-metric aggregates.
    """
    n = F.col("n_x")
    cov = F.when(F.col("expected_x") > 0, F.least(F.lit(1.0), F.col("n_unique_x") / F.col("expected_x")))
    df = df.withColumn("expected_x", F.coalesce(F.col("expected_x"), F.lit(0))).withColumn("coverage_ratio", cov)
    out = {}
    for m in METRICS:
        std = F.col(f"{m.key}_between_x_std")
        se = F.sqrt(F.col(f"{m.key}__se2") / (n * n) + F.coalesce(std * std / n, F.lit(0.0)))
        out |= {
            f"{m.key}_between_x_se": std / F.sqrt(n),
            f"{m.key}_total_se": se,
            f"{m.key}_stability_quality": -std,
            f"{m.key}_uncertainty_quality": -se,
        }
    many = n >= 2
    out |= {
        "has_multiple_x": many.cast("int"),
        "uncertainty_mode": F.when(many, F.lit("between_and_within")).otherwise(F.lit("within_only")),
        "reliability_weight": reliability_weight(n, F.col("coverage_ratio")),
        "normalization_fallback_used": F.col("__fallback").cast("int"),
        "reliability_warning": join_warnings(
            [
                (n == 1, "single_x_within_only"),
                (F.col("coverage_ratio") < 1.0, "partial_x_coverage"),
                (F.col("__fallback"), "normalization_fallback"),
            ]
        ),
    }
    per_metric = ("quality_mean", "quality_median", "between_x_std", "between_x_se", "within_se_mean", "total_se",
                  "stability_quality", "uncertainty_quality")
    return df.withColumns(out).select(
        *keys, "n_x", "n_unique_x", "expected_x", "coverage_ratio", "n_windows_total", "has_multiple_x", "uncertainty_mode",
        *[f"{m.key}_{s}" for m in METRICS for s in per_metric],
        "reliability_weight", "normalization_fallback_used", "reliability_warning",
    )


def aggregate_x(
    normalized: DataFrame,
    expected: DataFrame,
    keys: Sequence[str] = ("name", "subdir"),
    limit: int | None = HOT_GROUP_ROWS,
) -> DataFrame:
    """(device, subdir) quality with between-item and within-item uncertainty.

    ``n_x`` counts rows, coverage counts distinct items: they differ in a resample.
    """
    fell = F.lit(False)
    for m in METRICS:
        fell = fell | (F.col(f"{m.key}_normalization_level") != "subdir_x")
    aggs, wanted = uncertainty_aggregates()
    aggs += [F.bool_or(fell).alias("__fallback")]
    grouped = aggregate_with_quantiles(normalized, keys, aggs, wanted, limit, {"n_unique_x": "x"})
    return finish_uncertainty(keyed_join(grouped, expected, ["subdir"], "left"), keys)


def stage2_features(pred: DataFrame, subdirs: Sequence[str], keys: Sequence[str] = ("name",)) -> DataFrame:
    """Subdir predictions as columns, with reliability, warning and overall reliability per device.

    ``pred`` holds (keys, subdir, predicted_percentile, reliability_weight, reliability_warning).
    The list of subdirs is known from the model, so the pivot needs no extra job.
    """
    wide = pred.groupBy(*keys).pivot("subdir", list(subdirs)).agg(
        F.avg("predicted_percentile").alias("q"),
        F.avg("reliability_weight").alias("r"),
        F.min("reliability_warning").alias("w"),
    )
    q = [F.col(f"`{s}_q`") for s in subdirs]
    r = [F.col(f"`{s}_r`") for s in subdirs]
    available = total([c.isNotNull().cast("int") for c in q]) / float(len(subdirs))
    known = total([c.isNotNull().cast("int") for c in r])
    mean_r = F.coalesce(F.try_divide(total([F.coalesce(c, F.lit(0.0)) for c in r]), known), F.lit(0.25))
    cols = []
    for s in subdirs:
        cols += [
            F.col(f"`{s}_q`").alias(f"subdir::{s}"),
            F.col(f"`{s}_r`").alias(f"subdir::{s}__reliability"),
            F.coalesce(F.col(f"`{s}_w`"), F.lit("missing_subdir")).alias(f"subdir::{s}__warning"),
        ]
    return wide.select(*keys, *cols, clip(available * mean_r, 0.1, 1.0).alias("overall_reliability"))


def missing_subdirs(features: DataFrame, subdirs: Sequence[str]) -> DataFrame:
    """Coverage and warning text of each device from its stage-2 row."""
    gone = F.array_compact(F.array(*[F.when(F.col(f"`subdir::{s}`").isNull(), F.lit(s)) for s in subdirs]))
    low = F.col("overall_reliability") < 0.6
    return features.withColumns(
        {
            "subdir_coverage": 1.0 - F.size(gone) / float(max(len(subdirs), 1)),
            "reliability_warning": F.concat_ws(
                "|",
                F.when(F.size(gone) > 0, F.concat(F.lit("missing_subdirs="), F.array_join(gone, ","))),
                F.when(low, F.lit("low_overall_reliability")),
            ),
        }
    )
