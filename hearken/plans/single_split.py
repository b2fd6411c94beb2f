"""One-item-per-device evaluation of a linear model per subdir."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.operators.evaluation import name_validation, regression_metrics
from hearken.operators.folds import split_one_per_group
from hearken.operators.joins import join_labels
from hearken.operators.linear import fit_ridge, score
from hearken.operators.quality import usable_features
from hearken.operators.skew import keyed_join
from hearken.session import materialise


def evaluate_single_split(
    rows: DataFrame, labels: DataFrame, features: Sequence[str], ident: str = "x", alpha: float = 1.0, seed: int = 0, minimum: int = 3
) -> dict[str, DataFrame]:
    """Train on one random item per labelled device, validate on its other items, score unlabelled rows too.

    All subdirs are fitted together; a subdir needs ``minimum`` labelled devices and a
    usable feature. A feature that does not vary in the training rows has a zero row in
    the Gram system and so a zero weight, which equals leaving it out. ``alpha`` <= 0 is
    ordinary least squares.
    """
    data = join_labels(rows, labels, how="left").drop("matched")
    labelled = data.filter("human_score IS NOT NULL")
    enough = labelled.groupBy("subdir").agg(F.countDistinct("name").alias("n_names")).filter(F.col("n_names") >= minimum)
    data = keyed_join(data, enough.select("subdir"), ["subdir"], "left_semi")
    split = materialise(split_one_per_group(data.filter("human_score IS NOT NULL"), ["subdir", "name"], ident, seed))
    train = split.filter("is_train")
    usable = usable_features(train, features, ["subdir"])
    fits = materialise(fit_ridge(train, features, "human_score", [max(alpha, 0.0)], None, ["subdir"], nonneg=False))
    some = usable.filter("usable = 1").select("subdir").distinct()
    fits = keyed_join(fits, some, ["subdir"], "left_semi")
    cols = ["median", "mean", "scale", "coef", "intercept"]

    def scored(df: DataFrame) -> DataFrame:
        return keyed_join(df, fits.select("subdir", *cols), ["subdir"]).withColumn("predicted_score", score(features)).drop(*cols)

    error = F.col("predicted_score") - F.col("human_score")
    validation = materialise(scored(split.filter("NOT is_train")).withColumns({"signed_error": error, "absolute_error": F.abs(error)}))
    names = materialise(name_validation(validation, ["subdir"]))
    numbered = validation.withColumn("__row", F.xxhash64("name", ident))  # an item id alone is shared by all devices
    by_row = regression_metrics(numbered, ["subdir"], "__row", "human_score", "predicted_score")
    by_name = regression_metrics(names, ["subdir"], "name", "human_score", "predicted_score_mean")
    wanted = ("mae", "rmse", "pearson", "spearman", "kendall_tau")
    summary = keyed_join(
        by_row.select("subdir", F.col("n").alias("n_validation_rows"), *[F.col(c).alias(f"row_{c}") for c in wanted]),
        by_name.select("subdir", F.col("n").alias("n_validation_names"), *[F.col(c).alias(f"name_{c}") for c in wanted]), ["subdir"], "left",
    )
    summary = keyed_join(summary, names.groupBy("subdir").agg(F.avg("absolute_rank_difference").alias("mean_rank_error")), ["subdir"], "left")
    z = F.explode(F.arrays_zip("features", "coef"))
    coefficients = fits.select("subdir", z.alias("z")).select("subdir", F.col("z.features").alias("feature"), F.col("z.coef").alias("standardized_coefficient"))
    coefficients = keyed_join(coefficients, usable.filter("usable = 1").select("subdir", "feature"), ["subdir", "feature"], "left_semi")
    return {
        "train_rows": scored(train),
        "validation_rows": validation,
        "validation_name_ranking": names,
        "unlabeled_predictions": scored(data.filter("human_score IS NULL")),
        "model_coefficients": coefficients.withColumn("absolute_coefficient", F.abs("standardized_coefficient")),
        "summary": summary.orderBy(F.desc_nulls_last("name_spearman")),
        "fits": fits,
        "usable": usable,
    }


