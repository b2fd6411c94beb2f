"""Linear fits: certificates that the optimum was reached, and SQL where a closed form exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as A
from checks.registry import check, r, tidy
from checks.rollups import AGG_SQL, rated_fit
from hearken.config import PRIMARY, RECOMMENDED_FEATURES, STABILITY
from hearken.operators import linear as L
from hearken.operators.aggregate import aggregate_x
from hearken.operators.evaluation import percentile_target
from hearken.operators.normalize import apply_normalization, expected_items, fit_normalization
from hearken.operators.skew import keyed_join
from hearken.plans import fusion, softrank, windowed
from hearken.plans.selection import candidate_specs, overall_rows
from hearken.plans.single_split import evaluate_single_split
from hearken.session import materialise

SCALED = ("l2_quality_mean", "cosim_quality_mean", "l2_stability_quality")


def aggregated(spark, sf):
    x, fit = rated_fit(spark, sf)
    return materialise(aggregate_x(apply_normalization(x, fit_normalization(fit)), expected_items(fit)))


@check("d26_fit_scaler", f"WITH {AGG_SQL}, m AS (SELECT subdir, " + ", ".join(f"coalesce(quantile_cont({c}, 0.5), 0) AS m_{c}" for c in SCALED) + " FROM aggregated GROUP BY 1) "
       + " UNION ALL ".join(f"SELECT a.subdir, '{c}' AS feature, {r(f'max(m_{c})')} AS median, {r(f'avg(coalesce({c}, m_{c}))')} AS mean, "
                            f"{r(f'CASE WHEN stddev_pop(coalesce({c}, m_{c})) > 1e-12 THEN stddev_pop(coalesce({c}, m_{c})) ELSE 1 END')} AS scale FROM aggregated a JOIN m ON m.subdir = a.subdir GROUP BY 1" for c in SCALED))
def d26(spark, sf):
    return tidy(L.scaler_table(L.fit_scaler(aggregated(spark, sf), SCALED, ["subdir"]), SCALED, ["subdir"]))


@check("d26_apply_scaler", f"WITH {AGG_SQL}, m AS (SELECT subdir, " + ", ".join(f"coalesce(quantile_cont({c}, 0.5), 0) AS m_{c}" for c in SCALED) + " FROM aggregated GROUP BY 1), "
       "f AS (SELECT a.subdir, a.name, " + ", ".join(f"coalesce({c}, m_{c}) AS {c}, CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END AS g_{c}" for c in SCALED) + " FROM aggregated a JOIN m ON m.subdir = a.subdir) "
       "SELECT subdir, name, " + ", ".join(f"{r(f'({c} - avg({c}) OVER w) / CASE WHEN stddev_pop({c}) OVER w > 1e-12 THEN stddev_pop({c}) OVER w ELSE 1 END')} AS {c}, CAST(g_{c} AS DOUBLE) AS {c}__missing" for c in SCALED)
       + " FROM f WINDOW w AS (PARTITION BY subdir)")
def d26a(spark, sf):
    a = aggregated(spark, sf)
    out = L.apply_scaler(a.select("subdir", "name", *SCALED), L.fit_scaler(a, SCALED, ["subdir"]), SCALED, ["subdir"], indicators=True)
    return tidy(out)


def labelled_aggregate(spark, sf):
    agg = keyed_join(aggregated(spark, sf), A.subdir_labels(spark, sf), ["name", "subdir"])
    return materialise(percentile_target(agg, ["subdir"], "human_score"))


@check("j1_nn_ridge_certificate", f"WITH {A.XM}, {A.SUB}, d AS (SELECT DISTINCT sub.subdir, sub.name FROM sub JOIN xm ON xm.name = sub.name AND xm.subdir = sub.subdir), "
       "a AS (SELECT unnest([1.0, 10.0, 100.0]) AS alpha) SELECT subdir, CAST(alpha AS DOUBLE) AS alpha, count(*) AS n, CAST(1 AS BIGINT) AS nonnegative, CAST(1 AS BIGINT) AS stationary, CAST(1 AS BIGINT) AS complementary FROM d, a GROUP BY 1, 2")
def j1(spark, sf):
    """Optimality of every fit, recomputed from its Gram system."""
    fits = L.fit_ridge(labelled_aggregate(spark, sf), (*PRIMARY, *STABILITY), "target_percentile", [1.0, 10.0, 100.0], "reliability_weight", ["subdir"])
    k = L.kkt_residuals(fits)
    return tidy(k.select("subdir", "alpha", "n", (F.col("most_negative") >= -1e-12).alias("nonnegative"), (F.col("gradient_excess") <= 1e-8).alias("stationary"), (F.col("slackness") <= 1e-7).alias("complementary")))


COEFS = (("A", "intercept", 55.0), ("A", "l2_quality_mean", 9.0), ("N", "intercept", 45.0), ("N", "l2_quality_mean", 4.0), ("N", "cosim_quality_mean", 30.0), ("R", "intercept", 50.0), ("R", "cosim_quality_mean", 80.0))


@check("j2_linear_score", f"WITH {AGG_SQL}, s AS (SELECT name, subdir, CASE subdir WHEN 'A' THEN 55.0 + 9.0 * l2_quality_mean WHEN 'N' THEN 45.0 + 4.0 * l2_quality_mean + 30.0 * cosim_quality_mean "
       f"ELSE 50.0 + 80.0 * cosim_quality_mean END AS raw FROM aggregated) SELECT name, subdir, {r('raw')} AS raw, {r('least(greatest(raw, 0), 100)')} AS prediction FROM s")
def j2(spark, sf):
    coefs = spark.createDataFrame(list(COEFS), "subdir string, feature string, effective_coefficient double")
    return tidy(L.linear_score(aggregated(spark, sf), coefs, ["subdir"], ["l2_quality_mean", "cosim_quality_mean"], ["name", "subdir"]))


@check("j3_candidate_specs", """WITH s AS (SELECT l_returnflag AS subdir, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT unnest([1.0, 10.0, 100.0]) AS alpha),
    v AS (SELECT * FROM (VALUES ('primary', 0.0), ('stability', 0.0), ('full', 0.0), ('full', 0.05), ('full', 0.1), ('full', 0.2)) t(variant, gamma))
    SELECT subdir, n, variant || '|a=' || CAST(CAST(alpha AS INT) AS VARCHAR) || '|g=' || CASE WHEN gamma = 0 THEN '0' WHEN gamma = 0.05 THEN '0.05' WHEN gamma = 0.1 THEN '0.1' ELSE '0.2' END || '|aa=100' AS candidate_key, variant FROM s, a, v""")
def j3(spark, sf):
    s = A.load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("subdir")).agg(F.count(F.lit(1)).alias("n"))
    return tidy(keyed_join(s, candidate_specs(spark), [], small=True).select("subdir", "n", "candidate_key", "variant"))


# --- soft ranking --------------------------------------------------------------
def overall_rows_table(spark, sf):
    a = aggregated(spark, sf).withColumn("q", 50 + 9 * F.col("l2_quality_mean") + 4 * F.col("cosim_quality_mean"))
    wide = a.groupBy("name").pivot("subdir", ["A", "N", "R"]).agg(F.avg("q"))
    wide = keyed_join(wide, A.load(spark, sf, "supplier").select(A._dev("s_suppkey").alias("name"), (F.col("s_acctbal") > 2000).alias("__r")), ["name"])
    wide = wide.withColumn("R", F.when(F.col("__r"), F.col("R"))).drop("__r")
    return materialise(keyed_join(wide, A.overall_labels(spark, sf), ["name"]).withColumn("weight", F.lit(0.8)))


@check("j10_soft_rank_certificate", "WITH n AS (SELECT count(*) AS n FROM supplier WHERE s_acctbal >= 0), a AS (SELECT unnest([0.1, 1.0, 10.0]) AS alpha), l AS (SELECT unnest([0.25, 1.0, 4.0]) AS rank_lambda) "
       "SELECT CAST(alpha AS DOUBLE) AS alpha, CAST(rank_lambda AS DOUBLE) AS rank_lambda, n, CAST(1 AS BIGINT) AS feasible, CAST(1 AS BIGINT) AS optimal FROM n, a, l")
def j10(spark, sf):
    rows = overall_rows_table(spark, sf).withColumn("one", F.lit(1))
    fits = softrank.fit_groups(rows, ["A", "N", "R"], "overall_human_score", "weight", overall_rows(), ["one"])
    feasible = F.forall(F.slice("beta", 2, 3), lambda b: b >= 0)
    return tidy(fits.select("alpha", "rank_lambda", "n", feasible.alias("feasible"), (F.col("optimality") <= 1e-7).alias("optimal")))


@check("j10_soft_rank_large", "SELECT count(*) AS n, CAST(1 AS BIGINT) AS optimal, CAST(1 AS BIGINT) AS agrees FROM supplier WHERE s_acctbal >= 0")
def j10l(spark, sf):
    """The fit whose sums Spark computes block by block ends where the in-task fit ends."""
    rows = overall_rows_table(spark, sf)
    large = softrank.fit_large(rows, ["A", "N", "R"], "overall_human_score", "weight", 1.0, 1.0, block_rows=40)
    one = softrank.fit_groups(rows.withColumn("one", F.lit(1)), ["A", "N", "R"], "overall_human_score", "weight", [(0, "", 1.0, 1.0)], ["one"])
    same = F.lit(True)
    for i, b in enumerate(large["beta"]):
        same = same & (F.abs(F.col("beta")[i] - float(b)) < 1e-5)
    b, g = large["beta"], large["gradient"]
    stuck = max(abs(g[0]), max(abs(b[i] - max(b[i] - g[i], 0.0)) for i in range(1, 4)), max(abs(v) for v in g[4:]))
    return tidy(one.select("n", F.lit(bool(stuck < 1e-6)).alias("optimal"), same.alias("agrees")))


# --- ridge families --------------------------------------------------------------
def device_features(spark, sf):
    from hearken.operators.rollup import windows_to_x, x_to_device_subdir

    f = x_to_device_subdir(windows_to_x(A.nation_windows(spark, sf)))
    return materialise(keyed_join(f, A.nation_subdir(spark, sf), ["name", "subdir"]))


#: The window-level job's own list.
RIDGE_F = list(RECOMMENDED_FEATURES)


@check("j15_hierarchical_ridge", f"WITH {A.NAT_XM}, {A.NAT_OV}, {A.NAT_SUB}, d AS (SELECT DISTINCT sub.subdir, sub.name FROM sub JOIN xm ON xm.name = sub.name AND xm.subdir = sub.subdir), a AS (SELECT unnest([0.1, 1.0, 10.0]) AS alpha) "
       f"SELECT CAST(alpha AS DOUBLE) AS alpha, count(*) AS n, CAST({len(RIDGE_F) + 4} AS BIGINT) AS n_columns, CAST(1 AS BIGINT) AS normal_equations_hold FROM d, a GROUP BY 1")
def j15(spark, sf):
    """All features of the job, two task indicators and two interactions; the normal equations are checked."""
    fits, _, names = windowed.fit_hierarchical(device_features(spark, sf), "human_score", RIDGE_F, [0.1, 1.0, 10.0], [], ["A", "N", "R"], RIDGE_F[:1])
    k = L.kkt_residuals(fits)
    return tidy(k.select("alpha", "n", F.size("features").alias("n_columns"), (F.col("gradient_size") <= 1e-8).alias("normal_equations_hold")))


@check("j16_nested_lodo", f"WITH {A.NAT_XM}, {A.NAT_OV}, {A.NAT_SUB}, d AS (SELECT DISTINCT sub.subdir, sub.name FROM sub JOIN xm ON xm.name = sub.name AND xm.subdir = sub.subdir) "
       "SELECT name, subdir, CAST(1 AS BIGINT) AS predicted_once, CAST(1 AS BIGINT) AS all_fits_optimal FROM d")
def j16(spark, sf):
    res = windowed.nested_lodo(device_features(spark, sf), "human_score", RIDGE_F, ["A", "N", "R"], RIDGE_F[:1])
    worst = L.kkt_residuals(res["fits"]).agg((F.max("gradient_size") <= 1e-7).alias("all_fits_optimal"))
    rows = res["oof"].groupBy("name", "subdir").agg((F.count("predicted_score_oof") == 1).alias("predicted_once"))
    return tidy(keyed_join(rows, worst, [], small=True))


FUSION = ["l_quantity", "l_discount", "l_tax"]


def fusion_rows(spark, sf):
    li = A.load(spark, sf, "lineitem")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), *FUSION, (F.col("l_extendedprice") / 997.0).alias("mos"))


@check("j19_fusion_nnls", "SELECT count(*) AS n, CAST(1 AS BIGINT) AS nonnegative, CAST(1 AS BIGINT) AS stationary, CAST(1 AS BIGINT) AS complementary FROM lineitem")
def j19n(spark, sf):
    fits = fusion.fit_models(fusion_rows(spark, sf), FUSION, "mos", "nnls", ident="key")
    k = L.kkt_residuals(fits)
    return tidy(k.select("n", (F.col("most_negative") >= 0).alias("nonnegative"), (F.col("gradient_excess") <= 1e-8).alias("stationary"), (F.col("slackness") <= 1e-7).alias("complementary")))


@check("j19_fusion_ridge", "SELECT 'train_fit' AS scope, count(*) AS n, CAST(1 AS BIGINT) AS near_or_below_spread, CAST(1 AS BIGINT) AS normal_equations_hold FROM lineitem UNION ALL SELECT 'cross_validation', count(*), 1, 1 FROM lineitem")
def j19r(spark, sf):
    res = fusion.fit_fusion(fusion_rows(spark, sf), "mos", "ridge", FUSION)
    ok = L.kkt_residuals(res["model"]).agg((F.max("gradient_size") <= 1e-8).alias("normal_equations_hold"))
    spread = fusion_rows(spark, sf).agg(F.stddev_pop("mos").alias("__sd"))
    out = keyed_join(keyed_join(res["summary"], ok, [], small=True), spread, [], small=True)
    return tidy(out.select("scope", "n", (F.col("rmse") < 1.01 * F.col("__sd")).alias("near_or_below_spread"), "normal_equations_hold"))


@check("j20_original_weights", "SELECT count(*) AS n, CAST(1 AS BIGINT) AS same_score FROM lineitem")
def j20(spark, sf):
    """Weights in original units give the score of the scaled model."""
    rows = fusion_rows(spark, sf)
    fit = materialise(fusion.fit_models(rows, FUSION, "mos", "nnls", ident="key"))
    w = L.original_weights(fit).groupBy().pivot("feature", FUSION).agg(F.max("weight_original"))
    w = keyed_join(w, L.original_weights(fit).agg(F.max("intercept_original").alias("b0")), [], small=True)
    both = keyed_join(keyed_join(rows, fit.select("median", "mean", "scale", "coef", "intercept"), [], small=True), w.withColumnsRenamed({f: f"w_{f}" for f in FUSION}), [], small=True)
    plain = F.col("b0") + sum((F.col(f) * F.col(f"w_{f}") for f in FUSION), F.lit(0.0))
    return tidy(both.agg(F.count(F.lit(1)).alias("n"), (F.max(F.abs(plain - L.score(FUSION))) < 1e-9).alias("same_score")))


SPLIT_F = ["l2_mean", "cosim_mean", "kl_mean", "js_mean", "l2_var"]


@check("j21_single_split", f"WITH {A.XM}, {A.SUB}, l AS (SELECT xm.subdir, xm.name, xm.x, human_score FROM xm LEFT JOIN sub ON sub.name = xm.name AND sub.subdir = xm.subdir) "
       "SELECT subdir, count(*) FILTER (human_score IS NULL) AS n_unlabeled, count(DISTINCT CASE WHEN human_score IS NOT NULL THEN name END) AS n_train, "
       "count(*) FILTER (human_score IS NOT NULL) - count(DISTINCT CASE WHEN human_score IS NOT NULL THEN name END) AS n_validation, CAST(1 AS BIGINT) AS optimal FROM l GROUP BY 1")
def j21(spark, sf):
    res = evaluate_single_split(A.x_metrics(spark, sf), A.subdir_labels(spark, sf), SPLIT_F, alpha=1.0, seed=11)
    parts = [res["unlabeled_predictions"].select("subdir", F.lit("u").alias("k")), res["train_rows"].select("subdir", F.lit("t").alias("k")), res["validation_rows"].select("subdir", F.lit("v").alias("k"))]
    counts = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("subdir").agg(
        F.count_if(F.col("k") == "u").alias("n_unlabeled"), F.count_if(F.col("k") == "t").alias("n_train"), F.count_if(F.col("k") == "v").alias("n_validation"))
    opt = L.kkt_residuals(res["fits"]).select("subdir", (F.col("gradient_size") <= 1e-8).alias("optimal"))
    return tidy(keyed_join(counts, opt, ["subdir"]))
