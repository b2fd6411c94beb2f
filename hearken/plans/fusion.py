"""Fusion of objective metrics into one score."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearken.functions.directions import apply_directions, feature_columns, metric_directions
from hearken.functions.solvers import solve_elastic
from hearken.operators.evaluation import point_metrics
from hearken.operators.folds import assign_folds
from hearken.operators.linear import for_alphas, gram_table, original_weights, score, solve_grams
from hearken.operators.skew import keyed_join
from hearken.session import materialise

# Search grids.
RIDGE_ALPHAS = tuple(float(a) for a in np.logspace(-4, 4, 25))
ENET_ALPHAS = tuple(float(a) for a in np.logspace(-4, 2, 20))
ENET_RATIOS = (0.1, 0.3, 0.5, 0.7, 0.9)
MODELS = ("ridge", "elasticnet", "nnls")


def loo_errors(rows: DataFrame, grams: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """Mean squared leave-one-row-out error of every alpha, from leverages.

    The k*k inverses of each key (a handful of training sets) travel to the tasks;
    rows stay where they are and are reduced to one sum per key and alpha.
    """
    fitted = solve_grams(for_alphas(grams, alphas), F.col("alpha"), nonneg=False)
    small = fitted.select(*keys, "n", "alpha", "gram", "coef", "median", "mean", "scale", "x_center", "y_center").toPandas()
    k = len(features)
    table = {}
    for r in small.itertuples(index=False):
        d = r._asdict()
        inv = np.linalg.pinv(np.asarray(d["gram"], float).reshape(k, k) + d["alpha"] * np.eye(k), hermitian=True)
        table.setdefault(tuple(d[c] for c in keys), []).append((d["alpha"], d["n"], inv, *[np.asarray(d[c], float) for c in ("coef", "median", "mean", "scale", "x_center")], d["y_center"]))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def partial(batches):
        for pdf in batches:
            parts = pdf.groupby(list(keys), sort=False) if keys else [((), pdf)]
            for key, part in parts:
                raw, y = part[list(features)].to_numpy(float), part[target].to_numpy(float)
                out = []
                for alpha, n, inv, coef, median, mean, scale, xc, yc in table[tuple(key)]:
                    z = (np.where(np.isnan(raw), median, raw) - mean) / scale - xc
                    lever = 1.0 / n + np.einsum("ij,jk,ik->i", z, inv, z)
                    out.append([*key, alpha, float(np.sum(((y - yc - z @ coef) / np.maximum(1.0 - lever, 1e-12)) ** 2)), float(len(y))])
                yield pd.DataFrame(out, columns=[*keys, "alpha", "sq", "m"])

    schema = "".join(f"{c} {kinds[c]}, " for c in keys) + "alpha double, sq double, m double"
    cells = rows.select(*keys, *[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias(target))
    return cells.mapInPandas(partial, schema).groupBy(*keys, "alpha").agg((F.sum("sq") / F.sum("m")).alias("loo_mse"))


def _elastic_path(folds: np.ndarray, ratios: Sequence[float], alphas: Sequence[float]) -> tuple[float, float, list[float], float, list[float]]:
    """(ratio, strength, coefficients, intercept, inner errors) from the uncentred sums of each inner fold.

    Training sums are totals minus a fold, and a held-out error is a quadratic form in the fold's sums.
    """
    k = folds.shape[1] - 2
    whole = folds.sum(axis=0)
    grid = [(x, a) for x in ratios for a in alphas]
    l1, l2 = np.array([x * a for x, a in grid]), np.array([(1 - x) * a for x, a in grid])

    def fit(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, sx, sy = s[0, 0], s[0, 1 : k + 1], s[0, k + 1]
        g = (s[1 : k + 1, 1 : k + 1] - np.outer(sx, sx) / n) / n
        c = (s[1 : k + 1, k + 1] - sx * sy / n) / n
        b = solve_elastic(np.repeat(g[None], len(grid), 0), np.repeat(c[None], len(grid), 0), l1, l2)
        return b, (sy - b @ sx) / n

    error = np.zeros(len(grid))
    for held in folds if len(folds) > 1 else []:
        b, b0 = fit(whole - held)
        w = np.column_stack([-b0, -b, np.ones(len(grid))])
        error += np.einsum("ni,ij,nj->n", w, held, w) / held[0, 0]
    best = int(np.argmin(error))
    b, b0 = fit(whole)
    return grid[best][0], grid[best][1], b[best].tolist(), float(b0[best]), error.tolist()


ENET_FIT = T.StructType([
    T.StructField("l1_ratio", T.DoubleType()), T.StructField("alpha", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType())),
    T.StructField("intercept", T.DoubleType()), T.StructField("inner_errors", T.ArrayType(T.DoubleType())),
])


def elastic_net(rows: DataFrame, grams: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], inner: str, ratios=ENET_RATIOS, alphas=ENET_ALPHAS) -> DataFrame:
    """Elastic net per key with ratio and strength by inner folds (column ``inner``).

    Uncentred sums per (key, inner fold) are all that leaves the rows; each key's grid is
    solved where its few sums meet, on the executors.
    """
    m = len(features) + 2
    scaler = grams.select(*keys, "median", "mean", "scale")
    z = [F.lit(1.0), *[(F.coalesce(F.col(c).cast("double"), F.col("median")[i]) - F.col("mean")[i]) / F.col("scale")[i] for i, c in enumerate(features)], F.col(target).cast("double")]
    rows = keyed_join(rows, scaler, keys, small=True).withColumns({f"z{i}": c for i, c in enumerate(z)})
    cells = F.array(*[F.sum(F.col(f"z{min(i, j)}") * F.col(f"z{max(i, j)}")) for i in range(m) for j in range(m)])
    sums = rows.groupBy(*keys, F.col(inner).alias("inner")).agg(cells.alias("s"))

    @F.pandas_udf(ENET_FIT)
    def solve(folds: pd.Series) -> pd.DataFrame:
        fits = [_elastic_path(np.array([np.asarray(f, dtype=float) for f in fold]).reshape(len(fold), m, m), ratios, alphas) for fold in folds]
        return pd.DataFrame(fits, columns=ENET_FIT.fieldNames())

    held = F.transform(F.array_sort(F.collect_list(F.struct("inner", "s"))), lambda f: f["s"])
    fits = sums.groupBy(*keys).agg(held.alias("folds")).filter(F.size("folds") > 0).select(*keys, solve("folds").alias("fit"))
    return keyed_join(grams, fits.select(*keys, "fit.*"), keys)


def elastic_optimality(fits: DataFrame) -> DataFrame:
    """How far each elastic-net fit is from optimality, from its own Gram system: ``violation`` relative to the right-hand side.

    With slope s = c - G b - l2 b (all per row), s = l1 sign(b) where b is not zero and |s| <= l1 elsewhere.
    """
    k, n = F.size("rhs"), F.col("n").cast("double")
    l1, l2 = F.col("l1_ratio") * F.col("alpha"), (1 - F.col("l1_ratio")) * F.col("alpha")

    def off(i):
        b = F.element_at("coef", i + 1)
        dot = F.aggregate(F.zip_with(F.slice("gram", i * k + 1, k), "coef", lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)
        slope = F.element_at("rhs", i + 1) / n - dot / n - l2 * b
        return F.when(b != 0, F.abs(slope - l1 * F.signum(b))).otherwise(F.greatest(F.abs(slope) - l1, F.lit(0.0)))

    size = 1.0 + F.array_max(F.transform("rhs", lambda v: F.abs(v))) / n
    return fits.withColumn("violation", F.array_max(F.transform(F.sequence(F.lit(0), k - 1), off)) / size)


def fit_models(rows: DataFrame, features: Sequence[str], target: str, model: str, keys: Sequence[str] = (), ident: str = "__row", limit=None) -> DataFrame:
    """One fitted row per key: scaler, coefficients on standardised features, intercept, chosen strength."""
    options = {} if limit is None else {"limit": limit}
    # Keys are at most the held-out folds of one cross-validation.
    grams = materialise(gram_table(rows, features, target, None, keys, few=True, **options))
    if model == "nnls":
        return solve_grams(grams, F.lit(0.0))
    if model == "ridge":
        errors = loo_errors(rows, grams, features, target, keys, RIDGE_ALPHAS)
        best = errors.groupBy(*keys).agg(F.min_by("alpha", F.struct("loo_mse", "alpha")).alias("alpha"))
        return solve_grams(keyed_join(grams, best, keys), F.col("alpha"), nonneg=False)
    if model == "elasticnet":
        inner = rows.withColumn("__inner", F.pmod(F.xxhash64(F.lit("inner"), F.col(ident)), F.lit(5)).cast("int"))
        return elastic_net(inner, grams, features, target, keys, "__inner")
    raise ValueError(f"Unknown model: {model}; one of {MODELS}")


def fit_fusion(
    df: DataFrame, target: str, model: str = "ridge", features: Sequence[str] | None = None, ident: str = "key",
    exclude: Sequence[str] = (), overrides: dict | None = None, cv_splits: int = 5, seed: int = 1024,
) -> dict:
    """Fit a fusion model with cross-validated predictions, weights and summaries.

    Lower-is-better metrics are flipped first. With one split or fewer than four rows
    there is no cross-validated column.
    """
    features = list(features or feature_columns(df, [target, ident, *exclude]))
    if not features:
        raise ValueError("No feature columns selected")
    rows = apply_directions(df.dropna(subset=[target]), features, overrides).withColumn("__row", F.col(ident))
    final = materialise(fit_models(rows, features, target, model))
    cols = ["median", "mean", "scale", "coef", "intercept"]
    if cv_splits > 1:
        rows = materialise(assign_folds(rows, "__row", "kfold", cv_splits, seed))
    out = keyed_join(rows, final.select(*cols), [], small=True).withColumn("predicted_score_train_fit", score(features)).drop(*cols)
    summary = point_metrics(out, [], target, "predicted_score_train_fit").withColumn("scope", F.lit("train_fit"))
    if cv_splits > 1:
        folded = rows.filter("fold IS NOT NULL")
        if not folded.isEmpty():
            copies = folded.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(cv_splits - 1)))).filter("held <> fold")
            fits = materialise(fit_models(copies.drop("fold"), features, target, model, ["held"]))
            # One fit per fold: a row meets the fit that left it out.
            out = keyed_join(out, fits.select(F.col("held").alias("fold"), *cols), ["fold"], "left", small=True)
            out = out.withColumn("predicted_score_cv", score(features)).drop(*cols)
            summary = summary.unionByName(point_metrics(out, [], target, "predicted_score_cv").withColumn("scope", F.lit("cross_validation")))
        out = out.drop("fold")
    signs = metric_directions(features, overrides)
    word = {1: "higher_is_better", -1: "lower_is_better"}
    named = F.create_map(*[c for f in features for c in (F.lit(f), F.lit(word[signs[f]]))])
    return {
        "model": final,
        "predictions": out.drop("__row").withColumns({f"{f}__direction": F.lit(word[signs[f]]) for f in features}),
        "weights": original_weights(final).withColumn("direction", named[F.col("feature")]),
        "summary": summary,
        "features": features,
        "directions": {f: word[s] for f, s in signs.items()},
    }
