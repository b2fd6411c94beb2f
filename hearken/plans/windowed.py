"""Window-level training and prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearken.config import HOT_GROUP_ROWS, WINDOW_ALPHAS
from hearken.functions.directions import feature_columns
from hearken.operators.evaluation import point_metrics, tie_pair_metrics
from hearken.operators.folds import best_candidate
from hearken.operators.joins import join_labels
from hearken.operators.linear import apply_scaler, fit_scaler, for_alphas, gram_table, solve_grams
from hearken.operators.ranking import rank_against_reference
from hearken.operators.rollup import windows_to_x, x_to_device_subdir
from hearken.operators.skew import keyed_join
from hearken.plans.lattice import fold_map
from hearken.session import materialise


def reliability_weights(df: DataFrame, cap: float = 5.0, count: str = "n_audio", keys: tuple[str, ...] = (), out: str = "weight") -> DataFrame:
    """Square root of the capped item count, divided by its mean over the group."""
    raw = df.withColumn("__raw", F.sqrt(F.least(F.greatest(F.coalesce(F.col(count), F.lit(1)), F.lit(1)), F.lit(float(cap)))))
    mean = raw.groupBy(*keys).agg(F.avg("__raw").alias("__mean"))
    return keyed_join(raw, mean, keys, small=not keys).withColumn(out, F.col("__raw") / F.col("__mean")).drop("__raw", "__mean")


def design_columns(df: DataFrame, features: list[str], categories: list[str], interactions: list[str], subdir: str = "subdir") -> tuple[DataFrame, list[str]]:
    """Add 0/1 columns for all categories but the first, and their products with the (scaled) interaction columns."""
    value = F.coalesce(F.col(subdir), F.lit("<missing>")) if categories else None
    names, cols = list(features), {}
    for c in categories[1:]:
        name = f"{subdir}={c}"
        cols[name] = (value == c).cast("double")
        names.append(name)
    products = {f"{i}*{subdir}={c}": F.col(f"`{i}`") * (value == c).cast("double") for i in interactions if i in features for c in categories[1:]}
    return df.withColumns(cols | products), names + list(products)


def category_list(df: DataFrame, subdir: str = "subdir") -> list[str]:
    """Sorted task names; the task list of a protocol is short."""
    rows = df.select(F.coalesce(F.col(subdir), F.lit("<missing>")).alias("c")).distinct().orderBy("c").collect()
    return [r["c"] for r in rows]


def fit_hierarchical(
    df: DataFrame, target: str, features: list[str], alphas: list[float], keys: list[str], categories: list[str],
    interactions: list[str], weight_cap: float = 5.0,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Weighted ridge per key and alpha on scaled features, task indicators and interactions.

    Returns (fits, scaler, design names). Rows are weighted by the root of their item count.
    """
    weighted = reliability_weights(df, weight_cap, keys=tuple(keys)) if "n_audio" in df.columns else df.withColumn("weight", F.lit(1.0))
    scaler = materialise(fit_scaler(weighted, features, keys, limit=None if keys else HOT_GROUP_ROWS))
    scaled, names = design_columns(apply_scaler(weighted, scaler, features, keys), features, categories, interactions)
    safe = [f"d{i}" for i in range(len(names))]
    rows = scaled.select(*keys, target, "weight", *[F.col(f"`{n}`").alias(s) for n, s in zip(names, safe)])
    grams = materialise(gram_table(rows, safe, target, "weight", keys, limit=None, prescaled=safe))
    fits = solve_grams(for_alphas(grams, alphas), F.col("alpha"), nonneg=False)
    return materialise(fits), scaler, names


def score_hierarchical(df: DataFrame, fits: DataFrame, scaler: DataFrame, features: list[str], keys: list[str], categories: list[str], interactions: list[str]) -> DataFrame:
    """Rows with ``predicted`` for every fit (alpha) of their key."""
    scaled, names = design_columns(apply_scaler(df, scaler, features, keys), features, categories, interactions)
    joined = keyed_join(scaled, fits.select(*keys, "alpha", "coef", "intercept"), keys, small=not keys)
    out = F.col("intercept")
    for i, n in enumerate(names):
        out = out + F.col(f"`{n}`") * F.col("coef")[i]
    return joined.withColumn("predicted", out).drop("coef", "intercept", *[n for n in names if n not in features])


def nested_lodo(
    df: DataFrame, target: str, features: list[str], categories: list[str] | None = None, interactions: list[str] | None = None,
    alphas: tuple[float, ...] = WINDOW_ALPHAS, weight_cap: float = 5.0, folds: DataFrame | None = None, inner_folds: int = 5,
) -> dict:
    """Leave one device (or device group) out, with alpha chosen by inner group folds inside each training set.

    All (outer, inner) training sets are keys of one Gram table; outer -1 is the final
    fit and inner -1 the fit on the whole outer training set. The alpha with the smallest
    inner error wins, the earlier one in a tie; with fewer than three groups the middle one is taken.
    """
    categories, interactions = categories or [], interactions or []
    rows = df.dropna(subset=[target, "name"])
    folds = fold_map(rows, folds)
    rows = materialise(keyed_join(rows, folds.withColumnRenamed("fold", "own"), ["name"]).withColumn("__id", F.xxhash64("name", *[c for c in ("subdir",) if c in df.columns])))
    units = rows.groupBy("own").agg(F.count(F.lit(1)).alias("__size"))
    outers = units.agg(F.concat(F.array(F.lit(-1)), F.collect_list("own")).alias("__outer"))
    plan = keyed_join(units, outers, [], small=True).withColumn("outer", F.explode("__outer")).filter("own <> outer").drop("__outer")
    # Fold units are bounded, so numbering them per outer fold is small.
    w = Window.partitionBy("outer")
    plan = plan.withColumn("__groups", F.count(F.lit(1)).over(w)).withColumn(
        "inner", F.pmod(F.row_number().over(w.orderBy(F.desc("__size"), F.asc("own"))) - 1, F.least(F.lit(inner_folds), F.col("__groups"))).cast("int")
    )
    plan = materialise(plan.select("outer", "own", "inner", "__groups"))
    expanded = keyed_join(rows, plan, ["own"])
    hold = F.explode(F.sequence(F.lit(-1), F.when(F.col("__groups") >= 3, F.least(F.lit(inner_folds), F.col("__groups")) - 1).otherwise(F.lit(-1))))
    training = expanded.withColumn("hold", hold).filter("hold <> inner").drop("own", "inner", "__groups")
    keys = ["outer", "hold"]
    fits, scaler, names = fit_hierarchical(training, target, features, list(alphas), keys, categories, interactions, weight_cap)

    inner_rows = expanded.filter("__groups >= 3").withColumn("hold", F.col("inner"))
    inner_pred = score_hierarchical(inner_rows, fits, scaler, features, keys, categories, interactions)
    order = F.create_map(*[c for i, a in enumerate(alphas) for c in (F.lit(float(a)), F.lit(i))])
    errors = inner_pred.groupBy("outer", "alpha").agg(F.avg(F.abs(F.col("predicted") - F.col(target))).alias("mae")).withColumn("alpha_order", order[F.col("alpha")])
    best = best_candidate(errors, ["outer"], ["mae", "alpha_order"]).select("outer", "alpha")
    middle = float(alphas[len(alphas) // 2])
    chosen = materialise(
        keyed_join(plan.select("outer").distinct(), best, ["outer"], "left").select("outer", F.coalesce("alpha", F.lit(middle)).alias("alpha"))
    )
    held = rows.withColumns({"outer": F.col("own"), "hold": F.lit(-1)})
    oof = keyed_join(score_hierarchical(held, fits, scaler, features, keys, categories, interactions), chosen, ["outer", "alpha"])
    final = keyed_join(fits.filter("outer = -1 AND hold = -1"), chosen, ["outer", "alpha"]).drop("outer", "hold")
    return {
        "oof": oof.select(*df.columns, F.col("predicted").alias("predicted_score_oof")),
        "fold_alphas": keyed_join(chosen.filter("outer >= 0").withColumnRenamed("outer", "fold"), folds, ["fold"]).select(F.col("name").alias("held_out_device"), "alpha"),
        "inner_errors": errors,
        "fits": fits,
        "design": names,
        "model": {
            "fit": final, "scaler": scaler.filter("outer = -1 AND hold = -1").drop("outer", "hold"), "features": list(features),
            "categories": categories, "interactions": interactions, "names": names,
        },
    }


def weight_table(model: dict) -> DataFrame:
    """Standardised weight per design column."""
    names = F.array(*[F.lit(n) for n in model["names"]])
    return model["fit"].select(F.explode(F.arrays_zip(names.alias("feature"), "coef")).alias("z")).select(
        F.col("z.feature").alias("feature"), F.col("z.coef").alias("standardized_weight"))


def score_model(model: dict, df: DataFrame) -> DataFrame:
    """Rows with ``predicted`` by the final fit of ``nested_lodo``."""
    return score_hierarchical(df, model["fit"], model["scaler"], model["features"], [], model["categories"], model["interactions"]).drop("alpha")


def pivot_predictions(pred: DataFrame, subdirs: list[str], value: str) -> DataFrame:
    """One row per device, one column per known task; missing tasks are NULL columns."""
    wide = pred.groupBy("name").pivot("subdir", subdirs).agg(F.avg(value))
    return wide.select("name", *[F.col(f"`{s}`").alias(f"predicted_subdir_{s}") for s in subdirs])


def overall_table(pred: DataFrame, overall: DataFrame, subdirs: list[str], value: str = "predicted_score_oof") -> DataFrame:
    """Task predictions of each device next to its overall label."""
    return keyed_join(pivot_predictions(pred, subdirs, value), overall.select("name", "overall_human_score"), ["name"])


def train_windows(
    windows: DataFrame, sub_labels: DataFrame, overall: DataFrame, features: list[str] | None = None, interactions: list[str] | None = None,
    alphas: tuple[float, ...] = WINDOW_ALPHAS, weight_cap: float = 5.0, folds: DataFrame | None = None,
) -> dict:
    """Window-level training: roll-ups, task model, and an overall model when at least four devices allow it."""
    audio = materialise(windows_to_x(windows, optional="original_file" not in windows.columns))
    features_df = materialise(x_to_device_subdir(audio))
    labeled = materialise(join_labels(features_df, sub_labels))
    if labeled.isEmpty():
        raise ValueError("No device-subdir row matched the human scores")
    features = features or feature_columns(labeled, ["name", "subdir", "n_audio", "n_windows_total", "human_score"], prefer_recommended=True)
    subdirs = category_list(labeled)
    sub = nested_lodo(labeled, "human_score", features, subdirs, interactions, alphas, weight_cap, folds)
    sub_oof = materialise(sub["oof"])
    out = {
        "audio_level_features": audio, "device_subdir_features": features_df, "labeled_device_subdir_features": labeled,
        "subdir_oof_predictions": sub_oof, "subdir_fold_alphas": sub["fold_alphas"], "subdir_model_weights": weight_table(sub["model"]),
        "subdir_metrics": tie_pair_metrics(sub_oof, "name", "human_score", "predicted_score_oof", "subdir"),
        "subdir_point_metrics": point_metrics(sub_oof, [], "human_score", "predicted_score_oof"),
    }
    model = {"subdir": sub["model"], "subdirs": subdirs, "known_subdir": sub_labels, "known_overall": overall, "overall": None}
    table = materialise(overall_table(sub_oof, overall, subdirs))
    if table.count() >= 4:
        cols = [f"predicted_subdir_{s}" for s in subdirs]
        ov = nested_lodo(table, "overall_human_score", cols, alphas=alphas, weight_cap=weight_cap, folds=folds)
        ov_oof = materialise(ov["oof"])
        model["overall"] = ov["model"]
        out |= {
            "overall_oof_predictions": ov_oof, "overall_fold_alphas": ov["fold_alphas"], "overall_model_weights": weight_table(ov["model"]),
            "overall_metrics": tie_pair_metrics(ov_oof, "name", "overall_human_score", "predicted_score_oof"),
        }
    return {"model": model, "tables": out}


def predict_windows(model: dict, windows: DataFrame, tie_margin: float = 1.0) -> dict[str, DataFrame]:
    """Window-level prediction and ranking against the known scores, per task and overall."""
    audio = windows_to_x(windows, optional="original_file" not in windows.columns)
    features_df = materialise(x_to_device_subdir(audio))
    missing = sorted(set(model["subdir"]["features"]) - set(features_df.columns))
    if missing:
        raise ValueError(f"New-device table lacks trained features: {missing}")
    scored = materialise(score_model(model["subdir"], features_df).select(
        "name", "subdir", "n_audio", "n_windows_total", F.col("predicted").alias("predicted_subdir_score")))
    known = model["known_subdir"].filter("human_score IS NOT NULL").select("subdir", F.col("name").alias("known"), F.col("human_score").alias("score"))
    pred = scored.select("subdir", "name", F.col("predicted_subdir_score").alias("prediction"))
    out = {"new_subdir_predictions": scored, "new_subdir_ranking": rank_against_reference(pred, known, "subdir", tie_margin)}
    if model["overall"] is not None:
        wide = pivot_predictions(scored, model["subdirs"], "predicted_subdir_score")
        overall = materialise(score_model(model["overall"], wide).select("name", F.col("predicted").alias("predicted_overall_score")))
        ov_known = model["known_overall"].select(F.col("name").alias("known"), F.col("overall_human_score").alias("score"))
        out |= {
            "new_overall_predictions": overall,
            "new_overall_ranking": rank_against_reference(overall.select("name", F.col("predicted_overall_score").alias("prediction")), ov_known, None, tie_margin),
        }
    return out
