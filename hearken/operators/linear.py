"""Linear fits as Spark aggregates: scaler, Gram matrices, constrained solves, scoring."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearken.config import HOT_GROUP_ROWS
from hearken.functions.solvers import solve_free, solve_nonneg
from hearken.operators.skew import aggregate_with_quantiles, keyed_join


def fit_scaler(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), default: float = 0.0, limit: int | None = HOT_GROUP_ROWS
) -> DataFrame:
    """Per feature: median for imputation, then mean and population std of the imputed column (0 -> 1)."""
    med = _medians(df, columns, keys, default, limit)
    filled = keyed_join(df.select(*keys, *columns), med, keys)
    aggs = []
    for c in columns:
        v = F.coalesce(F.col(c).cast("double"), F.col(f"{c}__median"))
        aggs += [F.avg(v).alias(f"{c}__mean"), _unit_if_zero(F.stddev_pop(v)).alias(f"{c}__scale")]
    return keyed_join(med, filled.groupBy(*keys).agg(*aggs), keys)


def _medians(df, columns, keys, default, limit) -> DataFrame:
    med = aggregate_with_quantiles(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]), keys, [],
                                   {f"{c}__median": (c, 0.5) for c in columns}, limit)
    return med.select(*keys, *[F.coalesce(f"{c}__median", F.lit(float(default))).alias(f"{c}__median") for c in columns])


def _unit_if_zero(scale: Column) -> Column:
    return F.when(scale > 1e-12, scale).otherwise(F.lit(1.0))


def scaler_table(scaler: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Scaler in long form (keys, feature, median, mean, scale)."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{s}").alias(s) for s in ("median", "mean", "scale")]) for c in columns
    ])
    return scaler.select(*keys, F.explode(rows).alias("__r")).select(*keys, "__r.*")


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), indicators: bool = False) -> DataFrame:
    """Imputed and standardised columns; optional ``<c>__missing`` flags."""
    out = keyed_join(df, scaler, keys)
    new = {}
    if indicators:
        new |= {f"{c}__missing": F.col(c).isNull().cast("double") for c in columns}
    new |= {c: (F.coalesce(F.col(c).cast("double"), F.col(f"{c}__median")) - F.col(f"{c}__mean")) / F.col(f"{c}__scale") for c in columns}
    return out.withColumns(new).drop(*[f"{c}__{s}" for c in columns for s in ("median", "mean", "scale")])


def gram_table(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    weight: str | None = None,
    keys: Sequence[str] = (),
    limit: int | None = HOT_GROUP_ROWS,
    default: float = 0.0,
    prescaled: Sequence[str] = (),
    center: bool = True,
    few: bool = False,
) -> DataFrame:
    """One row per fit: scaler, weighted means and the weighted Gram system of the standardised features.

    Values are shifted by the median inside the sums, which keeps them well
    conditioned; everything after the median is one pass of sums that combine
    map-side, so only k*k numbers per fit are shuffled. Columns in ``prescaled``
    (indicators, interactions) are used as they are. ``few`` states that the number of keys
    is bounded: rows then stay where they are, and no task gathers the rows of a key.
    """
    scaled = [c for c in features if c not in prescaled]
    k = len(features)
    med = _medians(df, scaled, keys, default, limit) if scaled else df.groupBy(*keys).agg(F.lit(0).alias("__none"))
    rows = keyed_join(df, med, keys, small=few)
    # Several hundred small expressions: written as SQL text, which plans much faster than building them one call at a time.
    shift = {c: f"coalesce(CAST(`{c}` AS DOUBLE), `{c}__median`) - `{c}__median`" for c in scaled}
    shift |= {c: f"CAST(`{c}` AS DOUBLE)" for c in prescaled}
    weight_sql = "CAST(1 AS DOUBLE)" if weight is None else f"CAST(`{weight}` AS DOUBLE)"
    rows = rows.selectExpr(
        *[f"`{c}`" for c in keys], *[f"`{c}__median`" for c in scaled], *[f"{shift[c]} AS g{i}" for i, c in enumerate(features)],
        f"{weight_sql} AS w", f"CAST(`{target}` AS DOUBLE) AS y",
    )
    aggs = ["count(1) AS n", "sum(w) AS sw", "sum(w * y) AS swy", *[f"first(`{c}__median`) AS `{c}__median`" for c in scaled]]
    for i in range(k):
        aggs += [f"sum(w * g{i}) AS s{i}", f"sum(w * g{i} * y) AS y{i}"]
        aggs += [f"sum(w * g{i} * g{j}) AS c{i}_{j}" for j in range(i, k)]
        if features[i] in scaled:
            aggs += [f"avg(g{i}) AS m{i}", f"stddev_pop(g{i}) AS d{i}"]
    sums = rows.groupBy(*keys).agg(*[F.expr(a) for a in aggs])
    flat = [features[i] not in scaled for i in range(k)]
    mean = ["0D" if flat[i] else f"m{i}" for i in range(k)]
    scale = ["1D" if flat[i] else f"IF(d{i} > 1e-12, d{i}, 1D)" for i in range(k)]
    median = ["0D" if flat[i] else f"`{c}__median`" for i, c in enumerate(features)]
    xbar = [f"(s{i} / sw)" if center else mean[i] for i in range(k)]

    def cell(i: int, j: int) -> str:
        i, j = min(i, j), max(i, j)
        return f"(n / sw) * (c{i}_{j} - {xbar[j]} * s{i} - {xbar[i]} * s{j} + {xbar[i]} * {xbar[j]} * sw) / (z{i} * z{j})"

    rhs = [f"(n / sw) * (y{i} - {xbar[i]} * swy - (swy / sw) * (s{i} - {xbar[i]} * sw)) / z{i}" for i in range(k)]
    names = ", ".join("'" + c.replace("'", "\\'") + "'" for c in features)
    sums = sums.selectExpr("*", *[f"{scale[i]} AS z{i}" for i in range(k)])
    return sums.selectExpr(
        *[f"`{c}`" for c in keys], "n", f"array({names}) AS features",
        f"array({', '.join(median)}) AS median",
        f"array({', '.join(f'{m} + {d}' for m, d in zip(mean, median))}) AS mean",
        f"array({', '.join(f'z{i}' for i in range(k))}) AS scale",
        f"array({', '.join(f'({xbar[i]} - {mean[i]}) / z{i}' for i in range(k))}) AS x_center",
        "swy / sw AS y_center",
        f"array({', '.join(cell(i, j) for i in range(k) for j in range(k))}) AS gram",
        f"array({', '.join(rhs)}) AS rhs",
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(gram: pd.Series, rhs: pd.Series, alpha: pd.Series, nonneg: pd.Series) -> pd.Series:
    out: list = [None] * len(rhs)
    sizes = rhs.map(len).to_numpy()
    for k in np.unique(sizes):
        for sign in (True, False):
            rows = np.flatnonzero((sizes == k) & (nonneg.to_numpy() == sign))
            if not len(rows):
                continue
            a = np.stack(list(gram.iloc[rows])).reshape(len(rows), k, k)
            a = a + alpha.to_numpy()[rows][:, None, None] * np.eye(k)
            c = np.stack(list(rhs.iloc[rows]))
            b = solve_nonneg(a, c) if sign else solve_free(a, c)
            for r, v in zip(rows, b):
                out[r] = v
    return pd.Series(out)


def solve_grams(grams: DataFrame, alpha: Column, nonneg: bool = True) -> DataFrame:
    """Coefficients of each row's ridge system; ``intercept`` is free."""
    out = grams.withColumn("alpha", alpha.cast("double")).withColumn(
        "coef", _solve("gram", "rhs", "alpha", F.lit(nonneg))
    )
    cross = F.aggregate(F.zip_with("x_center", "coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return out.withColumn("intercept", F.col("y_center") - cross)


def for_alphas(grams: DataFrame, alphas: Sequence[float]) -> DataFrame:
    return grams.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))


def fit_ridge(
    df: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float], weight: str | None = None,
    keys: Sequence[str] = (), nonneg: bool = True, limit: int | None = HOT_GROUP_ROWS, **options,
) -> DataFrame:
    """Weighted ridge per group and alpha, non-negative by default. One row per fit."""
    grams = gram_table(df, features, target, weight, keys, limit, **options)
    return solve_grams(for_alphas(grams, alphas), F.col("alpha"), nonneg)


def kkt_residuals(fits: DataFrame) -> DataFrame:
    """How far each non-negative fit is from optimality, recomputed from its Gram system.

    ``most_negative`` (b >= 0), ``gradient_excess`` (no ascent direction left) and
    ``slackness`` (b * gradient = 0), the last two relative to the right-hand side.
    """
    k = F.size("rhs")
    slope = F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda i: F.element_at("rhs", i + 1)
        - F.col("alpha") * F.element_at("coef", i + 1)
        - F.aggregate(
            F.zip_with(F.slice("gram", i * k + 1, k), "coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
        ),
    )
    size = 1.0 + F.array_max(F.transform("rhs", lambda v: F.abs(v)))
    return fits.withColumn("__slope", slope).withColumns(
        {
            "most_negative": F.array_min("coef"),
            "gradient_excess": F.array_max("__slope") / size,
            "gradient_size": F.array_max(F.transform("__slope", lambda v: F.abs(v))) / size,
            "slackness": F.array_max(F.zip_with("__slope", "coef", lambda a, b: F.abs(a * b))) / size,
        }
    ).drop("__slope")


def score(features: Sequence[str], clip_to: tuple[float, float] | None = None) -> Column:
    """Prediction from the fit columns (median, mean, scale, coef, intercept) standing in the same row."""
    out = F.col("intercept")
    for i, c in enumerate(features):
        v = F.coalesce(F.col(c).cast("double"), F.col("median")[i])
        out = out + (v - F.col("mean")[i]) / F.col("scale")[i] * F.col("coef")[i]
    return out if clip_to is None else F.least(F.greatest(out, F.lit(clip_to[0])), F.lit(clip_to[1]))


def coefficient_table(fits: DataFrame, keys: Sequence[str], constraint: str = "nonnegative") -> DataFrame:
    """Long coefficients (keys, feature, coefficient, constraint), the intercept included."""
    named = F.transform(F.arrays_zip("features", "coef"), lambda z: F.struct(
        z["features"].alias("feature"), z["coef"].alias("coefficient"), F.lit(constraint).alias("constraint")))
    first = F.array(F.struct(F.lit("intercept").alias("feature"), F.col("intercept").alias("coefficient"), F.lit("free").alias("constraint")))
    return fits.select(*keys, F.explode(F.concat(first, named)).alias("__c")).select(*keys, "__c.*")


def original_weights(fits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weights on the unscaled features and the matching intercept, one row per feature."""
    z = F.explode(F.arrays_zip("features", "coef", "mean", "scale"))
    shift = F.aggregate(
        F.zip_with("coef", F.zip_with("mean", "scale", lambda m, s: m / s), lambda c, r: c * r), F.lit(0.0), lambda a, v: a + v
    )
    base = fits.withColumn("__b", F.col("intercept") - shift)
    return base.select(*keys, z.alias("__z"), F.col("__b").alias("intercept_original")).select(
        *keys,
        F.col("__z.features").alias("feature"),
        F.col("__z.coef").alias("weight_standardized"),
        (F.col("__z.coef") / F.col("__z.scale")).alias("weight_original"),
        "intercept_original",
    )


def linear_score(df: DataFrame, coefs: DataFrame, keys: Sequence[str], features: Sequence[str], entity: Sequence[str]) -> DataFrame:
    """Score from a long coefficient table: unpivot the features, join, sum; clipped to 0-100.

    ``coefs``: (keys, feature, effective_coefficient); the feature ``intercept`` is a constant 1.
    """
    pairs = F.array(
        F.struct(F.lit("intercept").alias("f"), F.lit(1.0).alias("v")),
        *[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in features],
    )
    long = df.select(*entity, F.explode(pairs).alias("__p")).select(*entity, F.col("__p.f").alias("feature"), F.col("__p.v").alias("__v"))
    raw = keyed_join(long, coefs, [*keys, "feature"]).groupBy(*entity).agg(F.sum(F.col("__v") * F.col("effective_coefficient")).alias("raw"))
    return raw.withColumn("prediction", F.least(F.greatest("raw", F.lit(0.0)), F.lit(100.0)))
