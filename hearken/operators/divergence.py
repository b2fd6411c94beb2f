"""Divergences between token distributions held as long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearken.config import HOT_GROUP_ROWS
from hearken.functions.exprs import finite_or_zero, log_add
from hearken.operators.skew import aggregate_with_quantiles, keyed_join

FLOOR = 1e-12


def common_extent(tokens: DataFrame, key: str = "pair_key") -> DataFrame:
    """Cut both sides of a pair to the steps and token ids below the smaller extent.

    Works on the per-side maxima (one row per pair), joined back on the pair key.
    """
    ends = tokens.groupBy(key).agg(
        *[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"__{c}_{s}") for c in ("step", "token_id") for s in ("p", "q")]
    ).select(key, *[F.least(f"__{c}_p", f"__{c}_q").alias(f"__{c}_end") for c in ("step", "token_id")])
    return keyed_join(tokens, ends, [key]).filter(
        (F.col("step") <= F.col("__step_end")) & (F.col("token_id") <= F.col("__token_id_end"))
    ).select(*tokens.columns)


def _sides(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both log-probabilities of a token in one row; a token absent on one side is NULL there.

    One aggregate on (keys, token) instead of a full outer join: half the shuffle,
    and a frequent token is combined map-side.
    """
    return tokens.groupBy(*keys, "token_id").agg(
        F.max(F.when(F.col("side") == "p", F.col("logprob"))).alias("lp"),
        F.max(F.when(F.col("side") == "q", F.col("logprob"))).alias("lq"),
    )


def divergence(tokens: DataFrame, keys: Sequence[str] = ("pair_key", "step")) -> DataFrame:
    """KL both ways, JS and entropies per step, in nats, over the full vocabulary.

    A token missing on one side has probability zero. Infinite terms count as zero,
    so disjoint support lowers the KL value.
    """
    both = _sides(require_same_kind(tokens), keys)
    lp, lq = F.col("lp"), F.col("lq")
    lm = log_add(lp, lq) - F.ln(F.lit(2.0))

    def kl(a, b):
        return F.when(a.isNotNull() & b.isNotNull(), finite_or_zero(F.exp(a) * (a - b))).otherwise(F.lit(0.0))

    def entropy(a):
        return F.coalesce(finite_or_zero(-F.exp(a) * a), F.lit(0.0))

    seen = F.count(lp) * F.count(lq) > 0
    return (
        both.groupBy(*keys)
        .agg(
            F.sum(kl(lp, lq)).alias("kl_pq"),
            F.sum(kl(lq, lp)).alias("kl_qp"),
            F.sum(0.5 * kl(lp, lm) + 0.5 * kl(lq, lm)).alias("js"),
            F.sum(entropy(lp)).alias("entropy_p"),
            F.sum(entropy(lq)).alias("entropy_q"),
            seen.alias("__both"),
        )
        .filter("__both")
        .drop("__both")
    )


def divergence_topk(tokens: DataFrame, keys: Sequence[str] = ("pair_key", "step")) -> DataFrame:
    """Approximate KL and JS from top-k records: the unseen mass of each side is one extra outcome.

    Everything is a sum over union tokens, so normalisation and divergence need two
    aggregates on the same keys and no row for the extra outcome.
    """
    both = _sides(require_same_kind(tokens), keys)
    p = F.coalesce(F.exp("lp"), F.lit(0.0))
    q = F.coalesce(F.exp("lq"), F.lit(0.0))
    floored = both.withColumns({"__p": F.greatest(p, F.lit(FLOOR)), "__q": F.greatest(q, F.lit(FLOOR)), "__rp": p, "__rq": q})
    mass = floored.groupBy(*keys).agg(
        F.greatest(1.0 - F.sum("__rp"), F.lit(FLOOR)).alias("__op"),
        F.greatest(1.0 - F.sum("__rq"), F.lit(FLOOR)).alias("__oq"),
        F.sum("__p").alias("__sp"),
        F.sum("__q").alias("__sq"),
        (F.count("lp") * F.count("lq") > 0).alias("__both"),
    ).filter("__both")
    joined = keyed_join(floored, mass, keys)

    def terms(a, b):
        m = 0.5 * (a + b)
        return a * (F.ln(a) - F.ln(b)), b * (F.ln(b) - F.ln(a)), 0.5 * a * (F.ln(a) - F.ln(m)) + 0.5 * b * (F.ln(b) - F.ln(m))

    np_, nq = F.col("__sp") + F.col("__op"), F.col("__sq") + F.col("__oq")
    inner = terms(F.col("__p") / np_, F.col("__q") / nq)
    rest = terms(F.col("__op") / np_, F.col("__oq") / nq)
    names = ("kl_pq", "kl_qp", "js")
    return joined.groupBy(*keys).agg(
        *[(F.sum(t) + F.first(r)).alias(n) for n, t, r in zip(names, inner, rest)]
    ).withColumn("type", F.lit("topk_approx"))


def require_same_kind(tokens: DataFrame) -> DataFrame:
    """Raise when a pair mixes full and top-k records; tables without the column ``kind`` hold one kind."""
    if "kind" not in tokens.columns:
        return tokens
    mixed = tokens.groupBy("pair_key").agg(F.min("kind").alias("a"), F.max("kind").alias("b")).filter("a <> b")
    found = mixed.orderBy("pair_key").limit(1).collect()
    if found:
        raise ValueError(f"Cannot compare full and top-k records of pair {found[0]['pair_key']}")
    return tokens


def top_k(tokens: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The k most likely tokens of each distribution, ties by token id.

    Two steps: each of 32 hash slices keeps its own k, so a huge vocabulary is
    never sorted in one task.
    """
    def best(df: DataFrame, part: list) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(F.desc("logprob"), F.asc("token_id"))
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    sliced = tokens.withColumn("__slice", F.pmod(F.xxhash64("token_id"), F.lit(32)))
    return best(best(sliced, [*keys, "__slice"]).drop("rank", "__slice"), list(keys))


def summarize(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], means_only: Sequence[str] = (), limit: int | None = HOT_GROUP_ROWS
) -> DataFrame:
    """Mean, population std, min, p50, p90, p95 and max of each series; one row per group."""
    aggs = [F.count(F.lit(1)).alias("num_steps")]
    wanted = {}
    for c in columns:
        v = F.col(c)
        aggs += [F.avg(v).alias(f"{c}_mean"), F.stddev_pop(v).alias(f"{c}_std"), F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max")]
        wanted |= {f"{c}_p50": (c, 0.5), f"{c}_p90": (c, 0.9), f"{c}_p95": (c, 0.95)}
    aggs += [F.avg(c).alias(f"{c}_mean") for c in means_only]
    return aggregate_with_quantiles(df, keys, aggs, wanted, limit)
