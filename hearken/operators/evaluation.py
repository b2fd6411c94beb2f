"""Regression, rank and pair metrics per group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.config import NOTICEABLE_GAP, PAIR_BLOCK_ROWS, PREFERENCE_SLOPE
from hearken.functions.exprs import is_finite
from hearken.operators.dominance import ordered_alike, tied_pairs
from hearken.operators.skew import average_rank, counts_at, keyed_join, pair_sums


def percentile_target(df: DataFrame, keys: Sequence[str], value: str, out: str = "target_percentile", bounded: bool = False) -> DataFrame:
    """Average rank as a percentile inside each group."""
    ranked = average_rank(df, keys, value, "__rank", "__n", bounded)
    return ranked.withColumn(out, 100.0 * (F.col("__rank") - 0.5) / F.col("__n")).drop("__rank", "__n")


def ecdf_transform(fit: DataFrame, new: DataFrame, keys: Sequence[str], value: str, out: str = "percentile") -> DataFrame:
    """Midpoint empirical distribution of ``fit`` evaluated at the values of ``new``."""
    sized = counts_at(fit, new, keys, value)
    mid = 0.5 * (F.col("n_lt") + F.col("n_le"))
    return sized.withColumn(out, F.try_divide(100.0 * mid, F.col("n_total"))).drop("n_lt", "n_le", "n_total")


def _correlation(x: Column, y: Column) -> Column:
    """NULL for fewer than two rows or a constant side; never divides by zero."""
    varies = (F.count(x) >= 2) & (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(v, -700.0, 700.0)))


def pair_kernel(gap: float, strict_gap: bool, slope: float, floor: float, clip_at: float | None, tie_margin: float | None):
    """Partial sums of every pair statistic for one block pair.

    ``strict_gap`` keeps pairs with a true difference above ``gap``, otherwise at
    or above it. With ``tie_margin`` the soft losses cover all pairs.
    """

    def kernel(a: list[np.ndarray], b: list[np.ndarray], mask: np.ndarray) -> dict[str, float]:
        dt = a[0][:, None] - b[0][None, :]
        dp = a[1][:, None] - b[1][None, :]
        dt, dp = dt[mask], dp[mask]
        st, sp = np.sign(dt), np.sign(dp)
        far = np.abs(dt) > gap if strict_gap else np.abs(dt) >= gap
        soft = np.ones(len(dt), dtype=bool) if tie_margin is not None else far
        bound = clip_at if clip_at is not None else np.inf
        target = _sigmoid(np.clip(slope * dt[soft], -bound, bound))
        prob = _sigmoid(np.clip(slope * dp[soft], -bound, bound))
        safe = np.clip(prob, floor, 1.0 - floor)
        brier_on = prob if tie_margin is not None else safe
        near = ~far
        return {
            "pairs": float(len(dt)),
            "concordant": float(np.sum(st * sp > 0)),
            "discordant": float(np.sum(st * sp < 0)),
            "ties_true": float(np.sum(st == 0)),
            "ties_pred": float(np.sum(sp == 0)),
            "far": float(np.sum(far)),
            "far_correct": float(np.sum((st == sp) & far)),
            "near": float(np.sum(near)),
            "near_correct": float(np.sum(near & (np.abs(dp) <= (tie_margin or 0.0)))),
            "soft": float(np.sum(soft)),
            "brier": float(np.sum((brier_on - target) ** 2)),
            "log_loss": float(-np.sum(target * np.log(safe) + (1.0 - target) * np.log(1.0 - safe))),
        }

    return kernel


PAIR_OUTPUTS = ("pairs", "concordant", "discordant", "ties_true", "ties_pred", "far", "far_correct", "near", "near_correct", "soft", "brier", "log_loss")


def finite_pairs(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.filter(is_finite(F.col(truth)) & is_finite(F.col(pred)))


def _sums(df, keys, ident, truth, pred, block_rows, **kernel) -> DataFrame:
    return pair_sums(df, keys, ident, [truth, pred], pair_kernel(**kernel), PAIR_OUTPUTS, block_rows)


def tau_b() -> Column:
    """Tie-corrected Kendall tau from pair sums."""
    untied = (F.col("pairs") - F.col("ties_true")) * (F.col("pairs") - F.col("ties_pred"))
    return F.when(untied > 0, F.try_divide(F.col("concordant") - F.col("discordant"), F.sqrt(untied)))


def rank_pairs(df: DataFrame, keys: Sequence[str], truth: str, pred: str, gap: float = 0.0, bounded: bool = False) -> DataFrame:
    """Counts of pairs: all, tied, ordered alike and oppositely, and those more than ``gap`` apart in truth. No pair is formed."""
    near = [gap] if gap > 0 else []
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    parts = [
        ordered_alike(df, keys, truth, pred, bounded=bounded).withColumnRenamed("alike", "concordant"),
        tied_pairs(df, keys, [truth], "ties_true"), tied_pairs(df, keys, [pred], "ties_pred"), tied_pairs(df, keys, [truth, pred], "__both"),
    ]
    for g in near:
        parts.append(ordered_alike(df, keys, truth, pred, g, bounded=bounded).withColumnRenamed("alike", "far_correct"))
        ends = df.select(*keys, (F.col(truth) - F.lit(g)).alias(truth))
        parts.append(counts_at(df, ends, keys, truth).groupBy(*keys).agg(F.sum("n_lt").cast("double").alias("far")))
    for part in parts:
        out = keyed_join(out, part, keys, "left")
    out = out.withColumn("pairs", F.col("__n") * (F.col("__n") - 1) / 2)
    if not near:
        out = out.withColumns({"far": F.col("pairs") - F.col("ties_true"), "far_correct": F.col("concordant")})
    against = F.col("pairs") - F.col("concordant") - F.col("ties_true") - F.col("ties_pred") + F.col("__both")
    return out.withColumn("discordant", against).select(*keys, "pairs", "concordant", "discordant", "ties_true", "ties_pred", "far", "far_correct")


def point_metrics(df: DataFrame, keys: Sequence[str], truth: str, pred: str, bounded: bool = False) -> DataFrame:
    """n, MAE, RMSE, Pearson and Spearman per group. Ranks first, then one aggregate."""
    valid = finite_pairs(df, truth, pred)
    ranked = average_rank(average_rank(valid, keys, truth, "__rt", "__n1", bounded), keys, pred, "__rp", "__n2", bounded)
    err = F.col(pred) - F.col(truth)
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        _correlation(F.col(truth), F.col(pred)).alias("pearson"),
        _correlation(F.col("__rt"), F.col("__rp")).alias("spearman"),
    )


def regression_metrics(
    df: DataFrame, keys: Sequence[str], ident: str, truth: str, pred: str, gap: float = 0.0, bounded: bool = False
) -> DataFrame:
    """All regression and rank metrics; pairs within ``gap`` of each other are skipped."""
    points = point_metrics(df, keys, truth, pred, bounded)
    sums = rank_pairs(finite_pairs(df, truth, pred), keys, truth, pred, gap, bounded)
    pairs = sums.select(
        *keys, tau_b().alias("kendall_tau"), F.try_divide(F.col("far_correct"), F.col("far")).alias("pairwise_ranking_accuracy")
    )
    return keyed_join(points, pairs, keys, "left")


def overall_metrics(
    df: DataFrame, keys: Sequence[str], ident: str, truth: str, pred: str,
    bounded: bool = False, block_rows: int = PAIR_BLOCK_ROWS,
) -> DataFrame:
    """Point metrics plus the pair metrics of noticeable differences.

    Accuracy, Brier score and soft cross-entropy use pairs whose true difference reaches the noticeable gap.
    """
    points = point_metrics(df, keys, truth, pred, bounded)
    sums = _sums(finite_pairs(df, truth, pred), keys, ident, truth, pred, block_rows,
                 gap=NOTICEABLE_GAP, strict_gap=False, slope=PREFERENCE_SLOPE, floor=1e-7, clip_at=None, tie_margin=None)
    pairs = sums.select(
        *keys,
        tau_b().alias("kendall_tau"),
        F.try_divide(F.col("far_correct"), F.col("far")).alias("pairwise_ranking_accuracy"),
        F.try_divide(F.col("brier"), F.col("soft")).alias("pairwise_brier_score"),
        F.try_divide(F.col("log_loss"), F.col("soft")).alias("pairwise_log_loss"),
        F.col("soft").cast("long").alias("n_pairs"),
    )
    return keyed_join(points, pairs, keys, "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))


def tie_pair_metrics(
    df: DataFrame, ident: str, truth: str, pred: str, group: str | None = None,
    tie_margin: float = 1.0, at_margin: float = 0.8, block_rows: int = PAIR_BLOCK_ROWS,
) -> DataFrame:
    """Pair metrics with a tie margin; pairs stay inside ``group`` and are pooled over groups."""
    keys = [group] if group else []
    valid = finite_pairs(df, truth, pred)
    sums = _sums(valid, keys, ident, truth, pred, block_rows, gap=tie_margin, strict_gap=True,
                 slope=float(np.log(at_margin / (1.0 - at_margin)) / tie_margin), floor=1e-8, clip_at=50.0, tie_margin=tie_margin)
    pooled = sums.agg(*[F.sum(c).alias(c) for c in PAIR_OUTPUTS])
    return pooled.select(
        F.try_divide(F.col("far_correct"), F.col("far")).alias("pairwise_accuracy_over_margin"),
        F.col("far").cast("long").alias("num_ordered_pairs"),
        F.try_divide(F.col("near_correct"), F.col("near")).alias("tie_accuracy"),
        F.col("near").cast("long").alias("num_tie_pairs"),
        F.try_divide(F.col("brier"), F.col("pairs")).alias("pairwise_brier"),
        F.try_divide(F.col("log_loss"), F.col("pairs")).alias("pairwise_log_loss"),
    )


def selection_loss(metrics: DataFrame, overall: bool = False) -> DataFrame:
    """Composite loss that model selection minimises; missing metrics take neutral values."""
    loss = (
        F.coalesce("mae", F.lit(100.0))
        + 20.0 * (1.0 - F.coalesce("spearman", F.lit(0.0)))
        + 10.0 * (1.0 - F.coalesce("pairwise_ranking_accuracy", F.lit(0.5)))
    )
    if overall:
        loss = (
            loss
            + F.coalesce(20.0 * F.col("pairwise_brier_score"), F.lit(0.0))
            + F.coalesce(2.0 * F.col("pairwise_log_loss"), F.lit(0.0))
        )
    return metrics.withColumn("selection_loss", loss)


def name_validation(df: DataFrame, keys: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """Validation rows to one row per name, with descending average ranks and their difference."""
    per_name = df.groupBy(*keys, "name").agg(
        F.min("human_score").alias("human_score"),
        F.avg("predicted_score").alias("predicted_score_mean"),
        F.stddev_samp("predicted_score").alias("predicted_score_std"),
        F.count(F.lit(1)).alias("n_validation_ids"),
    )
    flipped = per_name.withColumns({"__h": -F.col("human_score"), "__p": -F.col("predicted_score_mean")})
    ranked = average_rank(flipped, keys, "__h", "human_rank", "__n1", bounded)
    ranked = average_rank(ranked, keys, "__p", "predicted_rank", "__n2", bounded)
    diff = F.col("predicted_rank") - F.col("human_rank")
    return ranked.withColumns({"rank_difference": diff, "absolute_rank_difference": F.abs(diff)}).drop("__h", "__p", "__n1", "__n2")
