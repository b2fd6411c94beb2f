"""Nested training, prediction, bootstrap, domains and sessions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks import adapters as A
from checks.registry import check, r, tidy
from checks.rollups import AGG_SQL, rated_fit
from checks.sources import scratch
from hearken.config import METRICS, PRIMARY, STABILITY
from hearken.operators import linear as L
from hearken.operators.normalize import expected_items, fit_normalization
from hearken.operators.skew import keyed_join
from hearken.plans import bootstrap as B
from hearken.plans import domains as D
from hearken.plans import lattice as G
from hearken.plans import scoring, softrank, training, windowed
from hearken.sources.tables import read_auxiliary

NAT_D = f"{A.NAT_XM}, {A.NAT_OV}, {A.NAT_SUB}, d AS (SELECT DISTINCT sub.subdir, sub.name FROM sub JOIN xm ON xm.name = sub.name AND xm.subdir = sub.subdir), c AS (SELECT subdir, count(*) AS n FROM d GROUP BY 1)"


def lattice(spark, sf, **grid):
    return G.build(A.nation_x(spark, sf), A.nation_subdir(spark, sf), **grid)


SMALL = {"alphas": (10.0,), "gammas": (0.0, 0.1)}


@check("j7_fold_lattice", f"""WITH {NAT_D}, k AS (SELECT subdir, n, s FROM c, (SELECT unnest([0, 1, 2, 3]) AS s) t)
    SELECT subdir, CAST(s AS BIGINT) AS n_excluded, CAST(CASE s WHEN 0 THEN 1 WHEN 1 THEN n WHEN 2 THEN n * (n - 1) // 2 ELSE n * (n - 1) * (n - 2) // 6 END AS BIGINT) AS n_sets,
    n - s AS fewest_devices, CAST(1 AS BIGINT) AS optimal FROM k WHERE n - s >= 2""")
def j7(spark, sf):
    """Every exclusion set exists with the right training size, and every model of every set is optimal."""
    lat = lattice(spark, sf, **SMALL)
    bad = L.kkt_residuals(lat.models)
    ok = (F.col("most_negative") >= -1e-12) & (F.col("gradient_excess") <= 1e-8) & (F.col("slackness") <= 1e-6)
    sets = bad.filter("NOT array_contains(excl, -1)").groupBy("subdir", F.size("excl").alias("n_excluded")).agg(
        F.countDistinct("excl").alias("n_sets"), F.min("n").alias("fewest_devices"), F.bool_and(ok).alias("optimal"))
    return tidy(sets)


@check("j4_auxiliary_residuals", f"""WITH {NAT_D}, k AS (SELECT subdir, n, s FROM c, (SELECT unnest([0, 1, 2]) AS s) t)
    SELECT subdir, CAST(s AS BIGINT) AS n_excluded, CAST(CASE s WHEN 0 THEN n WHEN 1 THEN n * (n - 1) ELSE n * (n - 1) // 2 * (n - 2) END AS BIGINT) AS n_residuals,
    CAST(1 AS BIGINT) AS within_range, CAST(1 AS BIGINT) AS optimal FROM k WHERE n - s >= 3""")
def j4(spark, sf):
    """One residual per training device of every set; the auxiliary fits on them are optimal."""
    lat = lattice(spark, sf, **SMALL)
    preds = G._predictions(lat.rows.filter("NOT is_fit"), lat.models)
    targets = G.percentile_target(
        keyed_join(lat.rows.filter("is_fit"), lat.devices.select("subdir", "name", "human_score"), ["subdir", "name"]), ["subdir", "excl"], "human_score", bounded=True)
    res = G.residuals(targets.select("subdir", "excl", "name", "target_percentile"), preds)
    size = F.size("excl").alias("n_excluded")
    counts = res.groupBy("subdir", size).agg(F.count(F.lit(1)).alias("n_residuals"), (F.max(F.abs("residual")) <= 100).alias("within_range"))
    k = L.kkt_residuals(lat.aux_models).filter("NOT array_contains(excl, -1)")
    ok = (F.col("most_negative") >= -1e-12) & (F.col("gradient_excess") <= 1e-8) & (F.col("slackness") <= 1e-6)
    fits = k.groupBy("subdir", size).agg(F.bool_and(ok).alias("optimal"))
    return tidy(keyed_join(counts, fits, ["subdir", "n_excluded"]))


@check("j5_evaluate_candidates", f"""WITH {NAT_D}, k AS (SELECT subdir, n, b FROM c, (SELECT unnest([0, 1]) AS b) t), v AS (SELECT unnest(['primary', 'stability', 'full', 'full']) AS variant)
    SELECT subdir, CAST(b AS BIGINT) AS n_excluded, variant, CAST(CASE b WHEN 0 THEN 1 ELSE n END * count(*) AS BIGINT) AS n_rows, n - b AS n_devices, CAST(1 AS BIGINT) AS finite FROM k, v GROUP BY subdir, n, b, variant""")
def j5(spark, sf):
    m, _ = G.evaluate(lattice(spark, sf, **SMALL))
    fine = F.col("mae").between(0, 100) & F.col("selection_loss").isNotNull() & F.col("pairwise_ranking_accuracy").between(0, 1)
    return tidy(m.groupBy("subdir", F.size("excl").alias("n_excluded"), "variant").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("n").alias("n_devices"), F.bool_and(fine).alias("finite")))


@check("j8_crossfit_fixed_spec", f"WITH {NAT_D} SELECT subdir, name, CAST(1 AS BIGINT) AS n_predictions, CAST(1 AS BIGINT) AS in_range FROM d")
def j8(spark, sf):
    """Each device predicted once by the model that leaves it out."""
    lat = lattice(spark, sf, **SMALL)
    one = lat.candidates.filter("spec_idx = 1 AND size(excl) = 1 AND array_contains(excl, fold)")
    return tidy(one.groupBy("subdir", "name").agg(F.count(F.lit(1)).alias("n_predictions"), F.bool_and(F.col("predicted_percentile").between(0, 100)).alias("in_range")))


@check("j12_train", f"""WITH {NAT_D}, s AS (SELECT count(DISTINCT subdir) AS s, count(*) AS r FROM d), o AS (SELECT count(*) AS n FROM ov),
    t AS (SELECT 'subdir_oof_predictions' AS tbl, r AS n FROM s UNION ALL SELECT 'subdir_fold_selection', r FROM s UNION ALL SELECT 'subdir_candidate_metrics', s * 4 FROM s
    UNION ALL SELECT 'subdir_ablation', s * 3 FROM s UNION ALL SELECT 'overall_oof_predictions', n FROM o UNION ALL SELECT 'overall_stage2_oof', n FROM o
    UNION ALL SELECT 'overall_fold_selection', n FROM o UNION ALL SELECT 'overall_candidate_metrics', 4 FROM o UNION ALL SELECT 'overall_stage2_subdir_selection', n * s FROM o, s
    UNION ALL SELECT 'metrics', s + 1 FROM s UNION ALL SELECT 'normalized_x', (SELECT count(*) FROM xm) UNION ALL SELECT 'aggregated_name_subdir', (SELECT count(*) FROM (SELECT DISTINCT name, subdir FROM xm)))
    SELECT tbl, CAST(n AS BIGINT) AS n FROM t""")
def j12(spark, sf):
    """The whole training job on a small grid; row counts of the named result tables."""
    res = training.train(A.nation_x(spark, sf), A.nation_subdir(spark, sf), A.nation_overall(spark, sf), overall_alphas=(1.0, 10.0), lambdas=(0.25, 1.0), **SMALL)
    skip = {"normalization_stats", "model_weights"}
    out = None
    for name, df in res["tables"].items():
        if name not in skip:
            row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
            out = row if out is None else out.unionByName(row)
    return tidy(out)


@check("j9_j11_overall_nested", f"""WITH {NAT_D}, l AS (SELECT name, count(*) AS n_subdirs FROM d GROUP BY 1)
    SELECT ov.name, n_subdirs, CAST(1 AS BIGINT) AS n_predictions, CAST(1 AS BIGINT) AS features_are_out_of_fold, CAST(1 AS BIGINT) AS prediction_is_of_the_fit, CAST(1 AS BIGINT) AS all_fits_optimal FROM ov JOIN l USING (name)""")
def j9(spark, sf):
    """Evidence for the out-of-fold overall predictions: their subdir features are the subdir models' out-of-fold
    predictions, each is what the selected fit without its device gives, and every fit of the search is optimal."""
    res = training.train(A.nation_x(spark, sf), A.nation_subdir(spark, sf), A.nation_overall(spark, sf), overall_alphas=(1.0,), lambdas=(0.25, 1.0), **SMALL)
    t, subdirs = res["tables"], res["model"].subdirs
    columns = scoring.quality_columns(subdirs)
    own = t["subdir_oof_predictions"].groupBy("name").agg(F.count(F.lit(1)).alias("n_subdirs"), *[F.max(F.when(F.col("subdir") == s, F.col("predicted_percentile"))).alias(f"__{s}") for s in subdirs])
    both = keyed_join(keyed_join(t["overall_stage2_oof"], own, ["name"]), t["overall_oof_predictions"], ["name"])
    same = F.lit(True)
    for s, c in zip(subdirs, columns):
        same = same & (F.col(f"__{s}").isNull() | (F.abs(F.col(f"__{s}") - F.col(f"`{c}`")) < 1e-9))
    fits = res["overall_fits"].filter("ifold = -1").select("ofold", F.col("alpha").alias("selected_alpha"), F.col("rank_lambda").alias("selected_rank_lambda"), "median", "mean", "scale", "beta")
    scored = keyed_join(both.withColumn("__same", same), fits, ["ofold", "selected_alpha", "selected_rank_lambda"]).withColumn("__p", softrank.predict_expr(columns))
    rows = scored.groupBy("name").agg(
        F.max("n_subdirs").alias("n_subdirs"), F.count("overall_prediction").alias("n_predictions"), F.bool_and("__same").alias("features_are_out_of_fold"),
        F.bool_and(F.abs(F.col("__p") - F.col("overall_prediction")) < 1e-9).alias("prediction_is_of_the_fit"))
    return tidy(keyed_join(rows, res["overall_fits"].agg((F.max("optimality") <= 1e-6).alias("all_fits_optimal")), [], small=True))


# --- prediction from a given model ----------------------------------------------
P4 = [0.1, 0.2, -0.1, 0.05], [0.3, 0.1, 0.2, -0.2], [1.5, 1.25, 2.0, 0.75], [6.0, 2.0, 8.0, 1.0]
P8 = tuple(a + b for a, b in zip(P4, ([-0.9, -0.8, -0.3, -0.2], [-1.0, -0.7, -0.4, -0.1], [0.5, 0.75, 1.1, 1.3], [1.0, 2.0, 0.5, 0.0])))
AUXF = ["kl_quality_mean", "kl_quality_median", "js_quality_mean", "js_quality_median", "kl_stability_quality", "js_stability_quality"]
P6 = [0.0] * 6, [0.1] * 6, [1.2] * 6, [3.0, 0.0, 2.0, 1.0, 0.5, 0.25]


def _lin(features, params, intercept):
    med, mean, scale, coef = params
    return str(intercept) + " + " + " + ".join(f"(coalesce({f}, {a}) - {m}) / {s} * {c}" for f, a, m, s, c in zip(features, med, mean, scale, coef))


def given_model(spark, sf):
    x, fit = rated_fit(spark, sf)
    cols = "subdir string, variant string, alpha double, gamma double, median array<double>, mean array<double>, scale array<double>, coef array<double>, intercept double"
    rows = [("A", "primary", 1.0, 0.0, *P4, 50.0), ("N", "stability", 1.0, 0.0, *P8, 48.0), ("R", "full", 1.0, 0.1, *P8, 52.0)]
    aux = [("R", *P6, 2.0)]
    overall = [([50.0, 51.0, 52.0], [49.0, 50.0, 51.0], [12.0, 11.0, 10.0], [74.0, 4.0, 3.0, 5.0, -1.0, -2.0, -1.5])]
    return x, scoring.Model(
        ["A", "N", "R"], fit_normalization(fit), expected_items(fit), spark.createDataFrame(rows, cols),
        spark.createDataFrame(aux, "subdir string, median array<double>, mean array<double>, scale array<double>, coef array<double>, intercept double"),
        spark.createDataFrame(overall, "median array<double>, mean array<double>, scale array<double>, beta array<double>"), A.overall_labels(spark, sf))


PRED = f"""{AGG_SQL}, pr AS (SELECT name, subdir, reliability_weight AS w, least(greatest(CASE subdir WHEN 'A' THEN {_lin(PRIMARY, P4, 50.0)} WHEN 'N' THEN {_lin((*PRIMARY, *STABILITY), P8, 48.0)}
    ELSE {_lin((*PRIMARY, *STABILITY), P8, 52.0)} + 0.1 * ({_lin(AUXF, P6, 2.0)}) END, 0), 100) AS p FROM aggregated),
    wd AS (SELECT name, max(CASE WHEN subdir = 'A' THEN p END) AS qa, max(CASE WHEN subdir = 'N' THEN p END) AS qn, max(CASE WHEN subdir = 'R' THEN p END) AS qr, avg(w) * count(*) / 3.0 AS rel FROM pr GROUP BY 1),
    op AS (SELECT name, 74.0 + 4.0 * (coalesce(qa, 50) - 49) / 12 + 3.0 * (coalesce(qn, 51) - 50) / 11 + 5.0 * (coalesce(qr, 52) - 51) / 10
        - CASE WHEN qa IS NULL THEN 1.0 ELSE 0 END - CASE WHEN qn IS NULL THEN 2.0 ELSE 0 END - CASE WHEN qr IS NULL THEN 1.5 ELSE 0 END AS p, least(greatest(rel, 0.1), 1.0) AS rel FROM wd)"""


@check("j13_predict_subdirs", f"WITH {PRED} SELECT name, subdir, {r('p')} AS predicted_percentile FROM pr")
def j13s(spark, sf):
    x, model = given_model(spark, sf)
    return tidy(scoring.score_devices(model, x)["subdir_predictions"].select("name", "subdir", "predicted_percentile"))


@check("j13_predict_ranking", f"WITH {PRED}, dv AS (SELECT op.name, op.p, op.rel, ov.name AS known, overall_human_score AS s FROM op LEFT JOIN ov ON ov.name <> op.name) "
       f"SELECT name, {r('p')} AS overall_prediction, 1 + count(*) FILTER (s > p) AS estimated_rank, count(known) + 1 AS ranking_population, coalesce(arg_min(known, (s, known)) FILTER (s >= p + 2.0), '') AS nearest_clearly_better, "
       "coalesce(arg_max(known, s) FILTER (s <= p - 2.0), '') AS nearest_clearly_worse, coalesce(string_agg(known, '|' ORDER BY abs(s - p), known) FILTER (abs(s - p) < 2.0), '') AS approximately_equal_devices, "
       f"CAST(1 AS DOUBLE) AS subdir_coverage, {r('rel')} AS overall_reliability, CASE WHEN rel < 0.6 THEN 'low_overall_reliability' ELSE '' END AS reliability_warning FROM dv GROUP BY name, p, rel")
def j13(spark, sf):
    x, model = given_model(spark, sf)
    return tidy(scoring.predict(model, x)["ranking"])


@check("a14_model_round_trip", f"WITH {PRED} SELECT name, {r('p')} AS overall_prediction FROM op")
def a14(spark, sf):
    x, model = given_model(spark, sf)
    path = scratch(spark, "model")
    scoring.save_model(model, path)
    return tidy(scoring.score_devices(scoring.load_model(spark, path), x)["overall"].select("name", "overall_prediction"))


# --- bootstrap -------------------------------------------------------------------
@check("d27_bootstrap_summary", f"""WITH rp AS (SELECT 'dev_' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS name, l_returnflag AS subdir, l_extendedprice / 997.0 AS p, l_linenumber AS k FROM lineitem),
    md AS (SELECT name, subdir, CASE WHEN count(*) < 185 THEN 'within_parametric_only_limited' ELSE 'x_resample_plus_within_parametric' END AS m FROM rp GROUP BY 1, 2),
    lm AS (SELECT name, string_agg(subdir, '|' ORDER BY subdir) AS l FROM md WHERE m = 'within_parametric_only_limited' GROUP BY 1)
    SELECT rp.name, {r('quantile_cont(p, 0.025)')} AS overall_ci_low, {r('quantile_cont(p, 0.975)')} AS overall_ci_high, CAST(floor(quantile_cont(CAST(k AS DOUBLE), 0.025)) AS BIGINT) AS possible_rank_low,
    CAST(ceil(quantile_cont(CAST(k AS DOUBLE), 0.975)) AS BIGINT) AS possible_rank_high, count(*) AS bootstrap_replicates,
    CASE WHEN max(l) IS NULL THEN 'x_resample_plus_within_parametric' ELSE 'contains_within_only_limited_subdirs' END AS bootstrap_mode, coalesce(max(l), '') AS limited_ci_subdirs
    FROM rp LEFT JOIN lm ON lm.name = rp.name GROUP BY 1""")
def d27(spark, sf):
    """Intervals of a given replicate table."""
    li = A.load(spark, sf, "lineitem").select(A._dev("l_suppkey").alias("name"), F.col("l_returnflag").alias("subdir"), (F.col("l_extendedprice") / 997.0).alias("p"), F.col("l_linenumber").alias("k"))
    modes = li.groupBy("name", "subdir").agg(F.count(F.lit(1)).alias("n")).select("name", "subdir", F.when(F.col("n") < 185, B.LIMITED).otherwise(B.RESAMPLED).alias("bootstrap_mode"))
    o = li.select("name", F.col("p").alias("overall_prediction"), F.col("k").alias("estimated_rank"))
    return tidy(B.bootstrap_summary(o, li.select("name", "subdir", F.col("p").alias("predicted_percentile")), modes)["overall_summary"])


@check("j14_resample_shape", f"WITH {A.XM}, g AS (SELECT name, subdir, count(*) AS n FROM xm GROUP BY 1, 2) SELECT name, subdir, CAST(500 AS BIGINT) AS replicates, n * 500 AS n_rows, CAST(1 AS BIGINT) AS in_range, CAST(1 AS BIGINT) AS items_known FROM g")
def j14(spark, sf):
    x = A.x_metrics(spark, sf)
    fine = F.col("cosim_mean").between(-0.999999, 0.999999) & (F.col("l2_mean") >= 0) & (F.col("kl_mean") >= 0) & (F.col("js_mean") >= 0)
    # The redrawn rows are summed by item before they are shuffled; their replicates are kept as bits.
    bits = {f"__b{k}": F.expr(f"bit_or(IF(replicate DIV 64 = {k}, shiftleft(1L, replicate % 64), 0L))") for k in range(-(-500 // 64))}
    items = B.resample(x, 500, 5).groupBy("name", "subdir", "x").agg(F.count(F.lit(1)).alias("__n"), F.bool_and(fine).alias("__fine"), *[c.alias(n) for n, c in bits.items()])
    b = keyed_join(items, x.select("name", "subdir", "x", F.lit(True).alias("__k")), ["name", "subdir", "x"], "left")
    replicates = sum((F.bit_count(F.bit_or(n)) for n in bits), F.lit(0)).cast("long")
    return tidy(b.groupBy("name", "subdir").agg(replicates.alias("replicates"), F.sum("__n").alias("n_rows"), F.bool_and("__fine").alias("in_range"), F.bool_and(F.col("__k").isNotNull()).alias("items_known")))


@check("j14_bootstrap_intervals", f"WITH {PRED} SELECT name, CAST(500 AS BIGINT) AS bootstrap_replicates, CAST(1 AS BIGINT) AS ordered, CAST(1 AS BIGINT) AS has_point, 'A' AS limited_ci_subdirs FROM op")
def j14b(spark, sf):
    x, model = given_model(spark, sf)
    out = B.predict_with_intervals(model, x, 500, 3)["ranking"]
    ordered = (F.col("overall_ci_low") <= F.col("overall_ci_high")) & (F.col("possible_rank_low") <= F.col("possible_rank_high"))
    return tidy(out.select("name", "bootstrap_replicates", ordered.alias("ordered"), F.col("overall_prediction").isNotNull().alias("has_point"), "limited_ci_subdirs"))


def formula_draw(name, subdir, n, replicate):
    """Draws that SQL can repeat."""
    slot = np.arange(n)
    return (slot * 7 + replicate * 13) % n, np.sin(replicate * 31 + slot * 17 + np.arange(len(METRICS))[:, None])


def _redrawn(k, m):
    drawn = f"p.{m.mean} + sin(r * 31 + i.slot * 17 + {k}) * sqrt(greatest(p.{m.var}, 0) / greatest(1.0, (p.n_windows + 4) / 5.0))"
    return f"{f'least(greatest({drawn}, -0.999999), 0.999999)' if m.transform == 'fisher' else f'greatest({drawn}, 0)'} AS {m.mean}, p.{m.var}"


#: Replicates of all devices, named device#replicate, beside the devices that the statistics are fitted on.
_COLUMNS = ", ".join(f"{m.mean}, {m.var}" for m in METRICS)
_REPLICATES = f"""it AS (SELECT *, row_number() OVER (PARTITION BY name, subdir ORDER BY x) - 1 AS slot, count(*) OVER (PARTITION BY name, subdir) AS n FROM xm0),
    xm AS (SELECT name, subdir, x, n_windows, {_COLUMNS} FROM xm0 UNION ALL
    SELECT i.name || '#' || r, i.subdir, p.x, p.n_windows, {', '.join(_redrawn(k, m) for k, m in enumerate(METRICS))}
    FROM it i, (SELECT unnest(range(500)) AS r) JOIN it p ON p.name = i.name AND p.subdir = i.subdir AND p.slot = (i.slot * 7 + r * 13) % i.n)"""
_DRAWN = PRED.replace(A.XM, A.XM.replace(" xm AS (", " xm0 AS (") + ", " + _REPLICATES)


@check("j14_replicate_values", f"""WITH {_DRAWN}, rp AS (SELECT string_split(name, '#')[1] AS name, p FROM op WHERE contains(name, '#')),
    rk AS (SELECT rp.name, p, 1 + (SELECT count(*) FROM ov WHERE overall_human_score > p AND ov.name <> rp.name) AS k FROM rp)
    SELECT name, count(*) AS bootstrap_replicates, {r('quantile_cont(p, 0.025)')} AS overall_ci_low, {r('quantile_cont(p, 0.975)')} AS overall_ci_high,
    CAST(floor(quantile_cont(CAST(k AS DOUBLE), 0.025)) AS BIGINT) AS possible_rank_low, CAST(ceil(quantile_cont(CAST(k AS DOUBLE), 0.975)) AS BIGINT) AS possible_rank_high FROM rk GROUP BY 1""")
def j14_values(spark, sf):
    """The whole bootstrap with 500 replicates on given draws."""
    x, model = given_model(spark, sf)
    reps = B.bootstrap_replicates(model, x, 500, draw=formula_draw)
    out = B.bootstrap_summary(reps["overall_replicates"], reps["subdir_replicates"], B.resampling_modes(x))["overall_summary"]
    return tidy(out.select("name", "bootstrap_replicates", "overall_ci_low", "overall_ci_high", "possible_rank_low", "possible_rank_high"))


# --- window-level job --------------------------------------------------------------
@check("j18_window_training", f"WITH {NAT_D}, p AS (SELECT name, subdir, count(*) AS n FROM nat_windows GROUP BY 1, 2) SELECT p.name, p.subdir, n AS n_windows_total, CAST(1 AS BIGINT) AS has_prediction, (SELECT count(*) FROM sub WHERE sub.subdir = p.subdir) AS reference_device_count FROM p")
def j18(spark, sf):
    w = A.nation_windows(spark, sf)
    res = windowed.train_windows(w, A.nation_subdir(spark, sf), A.nation_overall(spark, sf))
    out = windowed.predict_windows(res["model"], w)
    both = keyed_join(out["new_subdir_predictions"], out["new_subdir_ranking"].select("name", "subdir", "reference_device_count"), ["name", "subdir"])
    return tidy(both.select("name", "subdir", "n_windows_total", F.col("predicted_subdir_score").isNotNull().alias("has_prediction"), "reference_device_count"))


@check("c12_overall_table", f"WITH {A.SCORED}, {A.OV} SELECT s.name, " + ", ".join(f"{r(f'avg(CASE WHEN subdir = {chr(39)}{s}{chr(39)} THEN pred END)')} AS predicted_subdir_{s}" for s in "ANR")
       + f", {r('max(overall_human_score)')} AS overall_human_score FROM scored s JOIN ov ON ov.name = s.name GROUP BY 1")
def c12(spark, sf):
    return tidy(windowed.overall_table(A.scored(spark, sf), A.overall_labels(spark, sf), ["A", "N", "R"], "pred"))


@check("c11_with_ci", f"WITH {A.OV}, ci AS (SELECT 'dev_' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS name, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1) SELECT ov.name, {r('overall_human_score')} AS overall_human_score, lo, hi FROM ov LEFT JOIN ci ON ci.name = ov.name")
def c11(spark, sf):
    from hearken.operators.joins import with_ci

    ci = A.load(spark, sf, "lineitem").groupBy(A._dev("l_suppkey").alias("name")).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return tidy(with_ci(A.overall_labels(spark, sf), ci, ["name"]))


# --- domains -----------------------------------------------------------------------
DOM = f"{A.AUX}, ds AS (SELECT *, least(greatest(20.0 + CASE WHEN domain = 'pc' THEN 3.0 ELSE 0 END + 0.4 * loudness + 0.3 * dynamics, 0), 100) AS predicted_overall, 0.11 * loudness + 0.07 * dynamics AS u FROM aux)"


def domain_rows(spark, sf):
    a = read_auxiliary(A.auxiliary(spark, sf))
    return D.score_domain(a, {"loudness": 0.4, "dynamics": 0.3}, 20.0, 3.0).withColumn("rank_utility", 0.11 * F.col("loudness") + 0.07 * F.col("dynamics"))


@check("j22_score_domain", f"WITH {DOM} SELECT name, domain, {r('predicted_overall')} AS predicted_overall FROM ds")
def j22(spark, sf):
    return tidy(domain_rows(spark, sf).select("name", "domain", "predicted_overall"))


REFS = "rf AS (SELECT 'ref_' || n_nationkey AS name, 'pc' AS domain, 10.0 + sin(n_nationkey) AS u FROM nation WHERE n_regionkey = 0)"


@check("j23_rank_domain", f"""WITH {DOM}, {REFS}, al AS (SELECT name, domain, u, FALSE AS f FROM ds UNION ALL SELECT name, domain, u, TRUE FROM rf),
    rk AS (SELECT *, rank() OVER (PARTITION BY domain ORDER BY u DESC) + (count(*) OVER (PARTITION BY domain, u) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY domain) AS n FROM al),
    wn AS (SELECT a.name, a.domain, avg(1.0 / (1.0 + exp(-(a.u - b.u)))) * 100 AS w FROM al a JOIN al b ON a.domain = b.domain AND a.name <> b.name GROUP BY 1, 2)
    SELECT rk.name, rk.domain, {r('u')} AS rank_utility, CAST(f AS BIGINT) AS is_reference, {r('k')} AS estimated_rank_1_is_best, {r('CASE WHEN n = 1 THEN 50.0 ELSE 100.0 * (n - k) / (n - 1) END')} AS rank_percentile,
    {r('coalesce(w, 50)')} AS expected_pairwise_win_percent, CASE WHEN f THEN 'active_bundle_reference' WHEN rk.domain = 'pc' THEN 'inductive_demo' ELSE 'demo_training_overlap_unchecked' END AS evaluation_scope
    FROM rk LEFT JOIN wn ON wn.name = rk.name AND wn.domain = rk.domain""")
def j23(spark, sf):
    refs = A.load(spark, sf, "nation").filter("n_regionkey = 0").select(F.concat(F.lit("ref_"), "n_nationkey").alias("name"), (10.0 + F.sin("n_nationkey")).alias("rank_utility"))
    return tidy(D.rank_domain(domain_rows(spark, sf), refs))


@check("d31_radar_scale", f"""WITH {DOM}, an AS (SELECT min(loudness) AS l0, max(loudness) AS l1, min(u) AS u0, max(u) AS u1, count(*) AS n FROM ds WHERE domain = 'tablet')
    SELECT name, {r('least(greatest(60 + 40 * (loudness - l0) / nullif(l1 - l0, 0), 0), 120)')} AS loudness_radar, {r('least(greatest(60 + 40 * (u - u0) / nullif(u1 - u0, 0), 0), 120)')} AS u_radar,
    CAST(80 AS DOUBLE) AS flat_radar, 'flat:tablet_zero_span_midpoint' AS scaling_status, n AS radar_anchor_count, 'tablet' AS radar_anchor_domain, 'tablet_session' AS radar_scaling_basis FROM ds, an WHERE domain = 'tablet'""")
def d31(spark, sf):
    t = domain_rows(spark, sf).filter("domain = 'tablet'").withColumnRenamed("rank_utility", "u").withColumn("flat", F.lit(7.0))
    out = D.radar_scale(t, t, ["loudness", "u", "flat"], "tablet")
    return tidy(out.select("name", "loudness_radar", "u_radar", "flat_radar", "scaling_status", "radar_anchor_count", "radar_anchor_domain", "radar_scaling_basis"))


@check("d32_trend", f"WITH {DOM} SELECT domain, count(*) AS n, {r('regr_slope(predicted_overall, dynamics)')} AS slope, {r('regr_intercept(predicted_overall, dynamics)')} AS intercept, {r('regr_r2(predicted_overall, dynamics)')} AS r2 FROM ds GROUP BY 1")
def d32(spark, sf):
    return tidy(D.trend(domain_rows(spark, sf), "dynamics", "predicted_overall"))


@check("f6_panels", f"WITH {DOM}, k AS (SELECT name, domain, row_number() OVER (PARTITION BY domain ORDER BY round(-u, 9), name) AS position FROM ds) SELECT name, domain, position, CAST(ceil(position / 7.0) AS BIGINT) AS panel FROM k WHERE position <= 14")
def f6(spark, sf):
    d = domain_rows(spark, sf).select("name", "domain", F.round(-F.col("rank_utility"), 9).alias("o"))
    return tidy(D.panel(d, ["domain"], "o").select("name", "domain", "position", "panel"))


# Batches of metric rows: one per order priority and status, with names that the auxiliary table lacks.
BATCH = f"""{A.AUX}, bt AS (SELECT DISTINCT c_nationkey * 40 + CAST(c_custkey // 40 AS BIGINT) AS batch_id, 'dev_' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS name FROM customer)"""


def batches(spark, sf):
    c = A.load(spark, sf, "customer")
    return c.select((F.col("c_nationkey") * 40 + F.floor(F.col("c_custkey") / 40)).cast("long").alias("batch_id"), A._dev("c_custkey").alias("name")).distinct()


BI = """bi AS (SELECT batch_id, count(*) AS n_names, count(domain) AS n_known, coalesce(min(domain) <> max(domain), FALSE) AS is_mixed, CASE WHEN min(domain) = max(domain) THEN min(domain) END AS domain
    FROM bt LEFT JOIN aux ON aux.name = bt.name GROUP BY 1)"""


@check("c15_batch_domain", f"WITH {BATCH}, {BI} SELECT batch_id, n_names, n_known, CAST(is_mixed AS BIGINT) AS is_mixed, domain FROM bi")
def c15(spark, sf):
    return tidy(D.batch_domain(batches(spark, sf), read_auxiliary(A.auxiliary(spark, sf))))


SESS = f"""{BATCH}, {BI}, ok AS (SELECT *, last_value(domain IGNORE NULLS) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM bi WHERE NOT is_mixed),
    ep AS (SELECT *, sum(CASE WHEN domain <> prev THEN 1 ELSE 0 END) OVER (ORDER BY batch_id) AS epoch FROM ok),
    lv AS (SELECT batch_id FROM ep WHERE epoch = (SELECT max(epoch) FROM ep)), rw AS (SELECT bt.batch_id, bt.name, aux.domain, min(CASE WHEN aux.domain IS NOT NULL THEN bt.batch_id END) OVER (PARTITION BY bt.name) AS f
    FROM bt JOIN lv ON lv.batch_id = bt.batch_id LEFT JOIN aux ON aux.name = bt.name)"""


@check("i2_session_replay", f"WITH {SESS} SELECT 'success' AS status, name, batch_id, '' AS reason FROM rw WHERE domain IS NOT NULL AND batch_id = f UNION ALL "
       "SELECT 'failure', name, max(batch_id), arg_max(CASE WHEN domain IS NULL THEN '其他评分 CSV 中找不到该 name' ELSE '当前结果中已存在相同 name' END, batch_id) FROM rw WHERE domain IS NULL OR batch_id > f GROUP BY name")
def i2(spark, sf):
    good, bad = D.session_state(batches(spark, sf), read_auxiliary(A.auxiliary(spark, sf)))
    g = good.select(F.lit("success").alias("status"), "name", "batch_id", F.lit("").alias("reason"))
    return tidy(g.unionByName(bad.select(F.lit("failure").alias("status"), "name", "batch_id", "reason")))
