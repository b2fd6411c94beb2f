"""Single-domain scoring, ranking, radar scaling and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.functions.exprs import clip, total
from hearken.operators.ranking import expected_win
from hearken.operators.skew import average_rank, keyed_join

# Domain labels, scope labels and the texts written with failures and radar scaling.
DOMAIN_LABELS = {"pc": "PC", "tablet": "Tablet"}
OTHER_LABEL = "设备"
SCOPES = {"pc": "inductive_demo", "tablet": "demo_training_overlap_unchecked", "fixed_reference": "active_bundle_reference"}
UNKNOWN_NAME = "其他评分 CSV 中找不到该 name"
ALREADY_PRESENT = "当前结果中已存在相同 name"
MIXED_BATCH = "mixed_domains"


def domain_label(domain: Column) -> Column:
    out = F.lit(OTHER_LABEL)
    for key, text in DOMAIN_LABELS.items():
        out = F.when(domain == key, text).otherwise(out)
    return out


def batch_domain(batches: DataFrame, auxiliary: DataFrame, key: str = "batch_id") -> DataFrame:
    """Per batch: names seen, names known, and its single domain (NULL when unknown or mixed)."""
    known = keyed_join(batches.select(key, "name").distinct(), auxiliary.select("name", "domain"), ["name"], "left")
    return known.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_names"),
        F.count("domain").alias("n_known"),
        F.coalesce(F.min("domain") != F.max("domain"), F.lit(False)).alias("is_mixed"),
        F.when(F.min("domain") == F.max("domain"), F.min("domain")).alias("domain"),
    )


def score_domain(df: DataFrame, coefficients: dict[str, float], intercept: float, pc_offset: float) -> DataFrame:
    """Linear score with an offset for the pc domain, limited to 0-100."""
    terms = [F.col(c).cast("double") * F.lit(float(b)) for c, b in coefficients.items()]
    offset = F.when(F.col("domain") == "pc", F.lit(float(pc_offset))).otherwise(F.lit(0.0))
    return df.withColumn("predicted_overall", clip(F.lit(float(intercept)) + offset + total(terms), 0.0, 100.0))


def rank_domain(session: DataFrame, references: DataFrame) -> DataFrame:
    """Rank of the devices of each domain by utility, with the expected win rate.

    ``session``: (name, domain, rank_utility). PC devices compete with the session's
    PCs and the fixed references; tablets only with each other. A lone device has rank 1,
    percentile 50 and win rate 50. With n > 1 the percentile is 100 * (n - rank) / (n - 1),
    a choice of ours: the rules do not define it.
    """
    refs = references.select("name", F.lit("pc").alias("domain"), "rank_utility", F.lit(True).alias("is_reference"))
    pcs = session.filter("domain = 'pc'").select("domain").distinct()
    refs = keyed_join(refs, pcs, ["domain"], "left_semi")
    everyone = session.select("name", "domain", "rank_utility", F.lit(False).alias("is_reference")).unionByName(refs)
    flipped = everyone.withColumn("__u", -F.col("rank_utility"))
    ranked = average_rank(flipped, ["domain"], "__u", "__rank", "__n").drop("__u")
    wins = expected_win(everyone, ["domain"], "name", "rank_utility").drop("n_compared")
    lone = F.col("__n") == 1
    out = keyed_join(ranked, wins, ["domain", "name"])
    scope = F.when(F.col("is_reference"), SCOPES["fixed_reference"]).when(F.col("domain") == "pc", SCOPES["pc"]).otherwise(SCOPES["tablet"])
    return out.select(
        "name", "domain", "rank_utility", "is_reference",
        F.col("__rank").alias("estimated_rank_1_is_best"),
        F.when(lone, 50.0).otherwise(100.0 * (F.col("__n") - F.col("__rank")) / F.greatest(F.col("__n") - 1, F.lit(1))).alias("rank_percentile"),
        "expected_pairwise_win_percent",
        scope.alias("evaluation_scope"),
    )


def radar_scale(df: DataFrame, anchors: DataFrame, columns: Sequence[str], domain: str) -> DataFrame:
    """Radar values from the anchor devices' range: minimum 60, maximum 100, limited to 0-120.

    Without any range a tablet axis is 80 and a pc axis NULL; the status text says so.
    Anchors are given apart from the devices drawn, so hidden devices count.
    """
    aggs = [F.count(F.lit(1)).alias("radar_anchor_count")]
    for c in columns:
        aggs += [F.min(c).alias(f"{c}_reference_min"), F.max(c).alias(f"{c}_reference_max")]
    limits = anchors.agg(*aggs)
    out = keyed_join(df, limits, [], small=True)
    flat = 80.0 if domain == "tablet" else None
    label = "tablet_zero_span_midpoint" if domain == "tablet" else "zero_reference_span"
    status = []
    for c in columns:
        lo, hi = F.col(f"{c}_reference_min"), F.col(f"{c}_reference_max")
        none = lo.isNull() | F.isnan(lo) | F.isnan(hi) | (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf"))
        span = hi - lo
        scaled = clip(60.0 + 40.0 * F.try_divide(F.col(c) - lo, span), 0.0, 120.0)
        out = out.withColumn(f"{c}_radar", F.when(none, F.lit(None).cast("double")).when(span <= 1e-12, F.lit(flat).cast("double")).otherwise(scaled))
        status += [F.when(none, F.lit(f"{c}:invalid_anchor")).when(span <= 1e-12, F.lit(f"{c}:{label}"))]
    return out.withColumns({
        "scaling_status": F.concat_ws("|", *status),
        "radar_anchor_domain": F.lit(domain),
        "radar_scaling_basis": F.lit("tablet_session" if domain == "tablet" else "pc_fixed_reference"),
    })


def trend(df: DataFrame, x: str, y: str, keys: Sequence[str] = ("domain",)) -> DataFrame:
    """Least-squares line of y on x per domain; NULL when x does not vary."""
    vx = F.when(F.col(y).isNotNull(), F.col(x))
    vy = F.when(F.col(x).isNotNull(), F.col(y))
    slope = F.try_divide(F.covar_pop(vx, vy), F.var_pop(vx))
    fit = df.groupBy(*keys).agg(
        F.count(F.when(vx.isNotNull() & vy.isNotNull(), 1)).alias("n"),
        slope.alias("slope"),
        (F.avg(vy) - slope * F.avg(vx)).alias("intercept"),
        F.try_divide(F.pow(F.covar_pop(vx, vy), 2), F.var_pop(vx) * F.var_pop(vy)).alias("r2"),
    )
    return fit


def panel(ranked: DataFrame, keys: Sequence[str], order: str, size: int = 7, panels: int = 2) -> DataFrame:
    """Default display panels: the first ``size`` devices by rank, then the next ``size``.

    A per-key top list of fixed length: every hash slice first keeps its own best rows.
    """
    def best(df: DataFrame, part: list) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(F.col(order).asc(), F.col("name").asc())
        return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= size * panels)

    sliced = ranked.withColumn("__slice", F.pmod(F.xxhash64("name"), F.lit(32)))
    top = best(best(sliced, [*keys, "__slice"]).drop("position", "__slice"), list(keys))
    return top.withColumn("panel", F.ceil(F.col("position") / float(size)).cast("int"))


def session_state(batches: DataFrame, auxiliary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batch replay of the single-domain session: final (successes, failures).

    ``batches``: (batch_id, name, ...) in arrival order of ``batch_id``. A mixed batch is
    rejected whole and changes nothing; a batch of the other domain starts a new epoch
    that clears what was there; a batch without any known name only adds failures. Inside
    an epoch the first occurrence of a name succeeds and later ones fail as duplicates.

    Epochs are numbered over the batch table (one row per batch, never the rows);
    row-level work is aggregates and joins only.
    """
    info = batch_domain(batches, auxiliary).filter("NOT is_mixed")
    order = Window.partitionBy(F.lit(0)).orderBy("batch_id")
    last = F.last("domain", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    info = info.withColumn("__switch", F.coalesce((F.col("domain") != last).cast("int"), F.lit(0)))
    info = info.withColumn("epoch", F.sum("__switch").over(order))
    current = info.agg(F.max("epoch").alias("__last"), F.max_by("domain", F.when(F.col("domain").isNotNull(), F.col("batch_id"))).alias("current_domain"))
    live = keyed_join(info, current, [], small=True).filter("epoch = __last").select("batch_id", "current_domain")
    rows = keyed_join(batches, live, ["batch_id"])
    rows = keyed_join(rows, auxiliary.select("name", F.lit(True).alias("__known")), ["name"], "left")
    firsts = rows.filter("__known").groupBy("name").agg(F.min("batch_id").alias("__first"))
    rows = keyed_join(rows, firsts, ["name"], "left")
    good = rows.filter(F.col("__known") & (F.col("batch_id") == F.col("__first"))).drop("__known", "__first").dropDuplicates(["batch_id", "name"])
    reason = F.when(F.col("__known").isNull(), UNKNOWN_NAME).otherwise(ALREADY_PRESENT)
    bad = rows.filter(F.col("__known").isNull() | (F.col("batch_id") > F.col("__first"))).select("name", "batch_id", reason.alias("reason"))
    failures = bad.groupBy("name").agg(F.max_by("reason", "batch_id").alias("reason"), F.max("batch_id").alias("batch_id"))
    return good, failures
