"""Robust normalisation inside (subdir, item) groups across devices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.config import HOT_GROUP_ROWS, METRICS
from hearken.functions.exprs import n_effective, stabilised_mean, stabilised_var
from hearken.operators.skew import hot_groups, keyed_join, long_values, split_hot, value_quantiles
from hearken.session import materialise

# Smallest usable scale and the factors that make MAD and IQR estimate a standard deviation.
EPS = 1e-8
MAD_FACTOR = 1.4826
IQR_FACTOR = 1.349

T_COLS = [f"{m.key}_t" for m in METRICS]


def stabilise(x: DataFrame) -> DataFrame:
    """Add ``n_effective`` and, per metric, the stabilised mean ``<key>_t`` and variance ``<key>_tv``."""
    out = {"n_effective": n_effective(F.col("n_windows"))}
    for m in METRICS:
        out[f"{m.key}_t"] = stabilised_mean(m)
        out[f"{m.key}_tv"] = stabilised_var(m)
    return x.withColumns(out)


def scale_cascade(n: Column, mad: Column, q25: Column, q75: Column, std: Column) -> tuple[Column, Column]:
    """Scale and method: MAD, else IQR, else standard deviation, else the constant 1."""
    by_mad, by_iqr = mad * MAD_FACTOR, (q75 - q25) / IQR_FACTOR
    choice = (
        F.when(n == 0, F.lit("constant"))
        .when(by_mad > EPS, F.lit("mad"))
        .when((n >= 2) & (by_iqr > EPS), F.lit("iqr"))
        .when((n >= 2) & (std > EPS), F.lit("std"))
        .otherwise(F.lit("constant"))
    )
    scale = F.when(choice == "mad", by_mad).when(choice == "iqr", by_iqr).when(choice == "std", std).otherwise(F.lit(1.0))
    return scale, choice


def robust_stats(df: DataFrame, keys: Sequence[str], values: Sequence[str], limit: int | None = HOT_GROUP_ROWS) -> DataFrame:
    """Per group and value column: ``<v>__center``, ``__scale``, ``__method``, ``__count``.

    The absolute deviation needs the median first. Ordinary groups get it from a
    window with the same partitioning as the aggregate, so there is one shuffle;
    very large groups read it off the value bins that hold the wanted ranks.
    """
    hot_keys = hot_groups(df, keys, limit)
    if hot_keys is None:
        return _one_shuffle_stats(df, keys, values)
    cold, hot = split_hot(df, keys, hot_keys)
    return _one_shuffle_stats(cold, keys, values).unionByName(_prefix_stats(hot, keys, values))


def _finish_stats(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    out = [F.col(k) for k in keys]
    for v in values:
        scale, method = scale_cascade(*[F.col(f"{v}__{s}") for s in ("count", "mad", "q25", "q75", "std")])
        out += [
            F.coalesce(F.col(f"{v}__center"), F.lit(0.0)).alias(f"{v}__center"),
            scale.alias(f"{v}__scale"),
            method.alias(f"{v}__method"),
            F.col(f"{v}__count").alias(f"{v}__count"),
        ]
    return df.select(*out)


def _one_shuffle_stats(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    rows = df.select(*keys, *values).withColumns({f"{v}__center": F.percentile(F.col(v), 0.5).over(w) for v in values})
    aggs = []
    for v in values:
        quarters = F.percentile(F.col(v), [0.25, 0.75])
        aggs += [
            F.count(v).alias(f"{v}__count"),
            F.first(f"{v}__center").alias(f"{v}__center"),
            F.percentile(F.abs(F.col(v) - F.col(f"{v}__center")), 0.5).alias(f"{v}__mad"),
            F.stddev_samp(v).alias(f"{v}__std"),
            quarters[0].alias(f"{v}__q25"),
            quarters[1].alias(f"{v}__q75"),
        ]
    return _finish_stats(rows.groupBy(*keys).agg(*aggs), keys, values)


def _prefix_stats(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    long = long_values(df, keys, values)
    wanted = {f"{v}__{n}": (v, p) for v in values for n, p in (("center", 0.5), ("q25", 0.25), ("q75", 0.75))}
    quantiles = materialise(value_quantiles(long, keys, wanted))
    centers = F.explode(F.array(*[F.struct(F.lit(v).alias("c"), F.col(f"{v}__center").alias("m")) for v in values]))
    centers = quantiles.select(*keys, centers.alias("__e")).select(*keys, F.col("__e.c").alias("__c"), F.col("__e.m").alias("__m"))
    deviations = keyed_join(long, centers, [*keys, "__c"], small=True).select(*keys, "__c", F.abs(F.col("__v") - F.col("__m")).alias("__v"))
    mads = value_quantiles(deviations, keys, {f"{v}__mad": (v, 0.5) for v in values})
    spread = df.groupBy(*keys).agg(*[a for v in values for a in (F.count(v).alias(f"{v}__count"), F.stddev_samp(v).alias(f"{v}__std"))])
    return _finish_stats(keyed_join(keyed_join(spread, quantiles, keys, "left"), mads, keys, "left"), keys, values)


def fit_normalization(x: DataFrame, limit: int | None = HOT_GROUP_ROWS) -> DataFrame:
    """Statistics at three levels in wide form: (level, subdir, x, <metric>_t__center/scale/method/count).

    One expansion feeds all levels, so the quantile passes run once, not three times; the
    few columns that they read are written first. The table is a fitted model part of bounded
    size; it is written out because every later step reads it once per level.
    """
    levels = F.array(
        F.struct(F.lit("subdir_x").alias("level"), F.col("subdir").alias("s"), F.col("x").alias("i")),
        F.struct(F.lit("subdir_fallback").alias("level"), F.col("subdir").alias("s"), F.lit("").alias("i")),
        F.struct(F.lit("global_fallback").alias("level"), F.lit("").alias("s"), F.lit("").alias("i")),
    )
    narrow = materialise(stabilise(x).select("subdir", "x", *T_COLS))
    rows = narrow.select(F.explode(levels).alias("__l"), *T_COLS).select(
        "__l.level", F.col("__l.s").alias("subdir"), F.col("__l.i").alias("x"), *T_COLS
    )
    return materialise(robust_stats(rows, ["level", "subdir", "x"], T_COLS, limit))


def normalization_table(stats: DataFrame, with_global: bool = False) -> DataFrame:
    """Long statistics table (level, subdir, x, metric, center, scale, method, count).

    The published table lists the item and subdir levels only; the stored model also needs the global one.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(m.key).alias("metric"),
                *[F.col(f"{m.key}_t__{s}").alias(s) for s in ("center", "scale", "method", "count")],
            )
            for m in METRICS
        ]
    )
    kept = stats if with_global else stats.filter(F.col("level") != "global_fallback")
    return kept.select("level", "subdir", "x", F.explode(rows).alias("__m")).select("level", "subdir", "x", "__m.*")


def stats_from_table(table: DataFrame) -> DataFrame:
    """Back from the long table to the wide form used by ``apply_normalization``."""
    aggs = [
        F.max(F.when(F.col("metric") == m.key, F.col(s))).alias(f"{m.key}_t__{s}")
        for m in METRICS
        for s in ("center", "scale", "method", "count")
    ]
    return table.groupBy("level", "subdir", "x").agg(*aggs)


def expected_items(x: DataFrame) -> DataFrame:
    """Number of distinct items per subdir in the fit population."""
    return x.groupBy("subdir").agg(F.countDistinct("x").alias("expected_x"))


def quality_columns() -> dict[str, Column]:
    """Quality and its standard error per metric, from ``<key>_t`` and its statistics."""
    out = {}
    for m in METRICS:
        center, scale = F.col(f"{m.key}_t__center"), F.col(f"{m.key}_t__scale")
        out[f"{m.key}_quality"] = F.lit(m.direction) * (F.col(f"{m.key}_t") - center) / scale
        out[f"{m.key}_within_se"] = F.sqrt(F.col(f"{m.key}_tv") / F.col("n_effective")) / scale
    return out


STAT_COLS = [f"{m.key}_t__{s}" for m in METRICS for s in ("center", "scale", "method")]


def with_statistics(x: DataFrame, stats: DataFrame) -> DataFrame:
    """Items with their centers, scales and methods; they fall back from item to subdir to global, and ``__level`` tells which.

    A row's level is the same for all four metrics because every level is fitted for all of them.
    """

    def at(level: str, keys: list[str]) -> DataFrame:
        return stats.filter(F.col("level") == level).select(*keys, F.struct(*STAT_COLS).alias(f"__{level}"))

    out = keyed_join(x, at("subdir_x", ["subdir", "x"]), ["subdir", "x"], "left")
    out = keyed_join(out, at("subdir_fallback", ["subdir"]), ["subdir"], "left")
    # The global level is a single row by construction.
    out = keyed_join(out, at("global_fallback", []), [], "left", small=True)
    level = (
        F.when(F.col("__subdir_x").isNotNull(), F.lit("subdir_x"))
        .when(F.col("__subdir_fallback").isNotNull(), F.lit("subdir_fallback"))
        .otherwise(F.lit("global_fallback"))
    )
    found = F.coalesce("__subdir_x", "__subdir_fallback", "__global_fallback")
    out = out.withColumns({"__level": level, "__stat": found}).withColumns({n: F.col(f"__stat.{n}") for n in STAT_COLS})
    return out.drop("__stat", "__subdir_x", "__subdir_fallback", "__global_fallback")


def apply_normalization(x: DataFrame, stats: DataFrame) -> DataFrame:
    """Normalised items, with the level and the method of their statistics."""
    out = with_statistics(stabilise(x), stats).withColumns(quality_columns())
    kept = [
        *x.columns,
        "n_effective",
        *[c for m in METRICS for c in (f"{m.key}_quality", f"{m.key}_within_se")],
        *[F.col("__level").alias(f"{m.key}_normalization_level") for m in METRICS],
        *[F.col(f"{m.key}_t__method").alias(f"{m.key}_normalization_method") for m in METRICS],
    ]
    return out.select(*kept)
