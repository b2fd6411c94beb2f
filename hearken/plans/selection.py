"""Candidate grids and the rules that choose among them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearken.config import ALLOWED_GAMMAS, AUXILIARY_ALPHA, OVERALL_ALPHAS, RANK_LAMBDAS, SUBDIR_ALPHAS
from hearken.functions.exprs import general_number as g
from hearken.operators.folds import best_candidate
from hearken.operators.skew import keyed_join

# Published names of the model variants.
ABLATION_NAMES = {
    "primary": "primary_only",
    "stability": "primary_plus_stability",
    "full": "primary_plus_stability_plus_kl_js",
}
ORDER = ("selection_loss", "alpha", "gamma", "spec_idx")


def check_gammas(gammas: Sequence[float]) -> None:
    wrong = sorted({float(x) for x in gammas} - set(ALLOWED_GAMMAS))
    if wrong:
        raise ValueError(f"gamma values must be chosen from {ALLOWED_GAMMAS}; got {wrong}")


def candidate_rows(
    alphas: Sequence[float] = SUBDIR_ALPHAS, gammas: Sequence[float] = ALLOWED_GAMMAS, auxiliary_alpha: float = AUXILIARY_ALPHA
) -> list[tuple]:
    check_gammas(gammas)
    grid = []
    for a in map(float, alphas):
        members = [("primary", 0.0), ("stability", 0.0), *(("full", float(x)) for x in gammas)]
        grid += [(v, a, x) for v, x in members]
    aa = float(auxiliary_alpha)
    return [
        (i, f"{v}|a={g(a)}|g={g(x)}|aa={g(aa)}", v, ABLATION_NAMES[v], a, x, aa) for i, (v, a, x) in enumerate(grid)
    ]


def candidate_specs(spark: SparkSession, *grid) -> DataFrame:
    """The per-subdir grid as a small table; ``spec_idx`` keeps the listing order for ties."""
    return spark.createDataFrame(
        candidate_rows(*grid),
        "spec_idx int, candidate_key string, variant string, ablation string, alpha double, gamma double, auxiliary_alpha double",
    )


def overall_rows(alphas: Sequence[float] = OVERALL_ALPHAS, lambdas: Sequence[float] = RANK_LAMBDAS) -> list[tuple]:
    pairs = [(float(a), float(x)) for a in alphas for x in lambdas]
    return [(i, f"a={g(a)}|rank={g(x)}", a, x) for i, (a, x) in enumerate(pairs)]


def overall_specs(spark: SparkSession, *grid) -> DataFrame:
    return spark.createDataFrame(overall_rows(*grid), "spec_idx int, candidate_key string, alpha double, rank_lambda double")


def select_candidate(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chosen candidate per group: the best plain model unless an auxiliary one earns its place.

    The auxiliary model must not be materially worse on any metric, must be clearly
    better on one, and must have the smaller loss.
    """
    role = F.when(F.col("variant") != "full", "base").when(F.col("gamma") > 0, "aux")
    best = best_candidate(metrics.withColumn("__role", role).filter("__role IS NOT NULL"), [*keys, "__role"], ORDER)
    base = best.filter("__role = 'base'").drop("__role")
    aux = best.filter("__role = 'aux'").select(
        *keys, F.struct(*[F.col(c) for c in metrics.columns if c not in keys]).alias("__aux")
    )
    duel = keyed_join(base, aux, keys, "left")

    def pair(name, default=None):
        mine, other = F.col(name), F.col(f"__aux.{name}")
        return (mine, other) if default is None else (F.coalesce(mine, F.lit(default)), F.coalesce(other, F.lit(default)))

    (mb, ma), (sb, sa), (pb, pa) = pair("mae"), pair("spearman", 0.0), pair("pairwise_ranking_accuracy", 0.5)
    lb, la = pair("selection_loss")
    no_worse = (ma <= mb + 0.5) & (sa >= sb - 0.01) & (pa >= pb - 0.01)
    gain = (ma <= mb - 0.5) | (sa >= sb + 0.01) | (pa >= pb + 0.01)
    accepted = F.coalesce(no_worse & gain & (la < lb), F.lit(False))
    chosen = duel.withColumn("auxiliary_accepted", accepted)
    cols = [c for c in metrics.columns if c not in keys]
    return chosen.select(
        *keys, *[F.when(F.col("auxiliary_accepted"), F.col(f"__aux.{c}")).otherwise(F.col(c)).alias(c) for c in cols],
        F.col("auxiliary_accepted").cast("int").alias("auxiliary_accepted"),
    )


def ablation(metrics: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best row of each variant, flagged when it is the selected candidate (column ``selected_idx`` of ``chosen``)."""
    best = best_candidate(metrics, [*keys, "variant"], ORDER)
    return keyed_join(best, chosen.select(*keys, "selected_idx"), keys, "left").withColumn(
        "selected_for_final", F.coalesce((F.col("spec_idx") == F.col("selected_idx")).cast("int"), F.lit(0))
    ).drop("selected_idx")


def sorted_summary(df: DataFrame, by: str, absolute: bool = False) -> DataFrame:
    """Rows in falling order of ``by`` with their position. For per-subdir or per-coefficient summaries."""
    key = F.abs(F.col(by)) if absolute else F.col(by)
    w = Window.partitionBy(F.lit(0)).orderBy(key.desc_nulls_last())
    return df.withColumn("position", F.row_number().over(w)).orderBy("position")
