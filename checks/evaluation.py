"""Ranks, regression and pair metrics, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as A
from checks.registry import check, r, tidy
from hearken.operators import evaluation as E
from hearken.operators import ranking as R
from hearken.operators.folds import best_candidate, modal_spec


def avg_rank_sql(value: str, part: str, order: str = "") -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {value} {order}) + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0)"


@check("e1_percentile_target", f"WITH {A.SUB} SELECT name, subdir, {r(f'100.0 * ({avg_rank_sql(chr(114)+chr(115), chr(115)+chr(117)+chr(98)+chr(100)+chr(105)+chr(114))} - 0.5) / count(*) OVER (PARTITION BY subdir)')} AS target_percentile "
       "FROM (SELECT name, subdir, round(human_score, 0) AS rs FROM sub)")
def e1(spark, sf):
    lab = A.subdir_labels(spark, sf).withColumn("rs", F.round("human_score", 0))
    return tidy(E.percentile_target(lab, ["subdir"], "rs").select("name", "subdir", "target_percentile"))


@check("e2_ecdf_transform", f"WITH {A.SCORED} SELECT s.name, s.subdir, {r('100.0 * 0.5 * (sum(CASE WHEN f.v < s.v THEN 1 ELSE 0 END) + sum(CASE WHEN f.v <= s.v THEN 1 ELSE 0 END)) / count(*)')} AS percentile "
       "FROM (SELECT name, subdir, round(pred, 1) AS v FROM scored) s JOIN (SELECT subdir, round(truth, 1) AS v FROM scored) f ON f.subdir = s.subdir GROUP BY 1, 2")
def e2(spark, sf):
    s = A.scored(spark, sf)
    fit = s.select("subdir", F.round("truth", 1).alias("v"))
    new = s.select("name", "subdir", F.round("pred", 1).alias("v"))
    return tidy(E.ecdf_transform(fit, new, ["subdir"], "v").select("name", "subdir", "percentile"))


_NV = f"""{A.XM}, {A.SUB}, vr AS (SELECT xm.name, xm.subdir, sub.human_score, 50 + 20 * cosim_mean + l2_mean AS predicted_score FROM xm
    JOIN sub ON sub.name = xm.name AND sub.subdir = xm.subdir),
    nv AS (SELECT subdir, name, min(human_score) AS human_score, avg(predicted_score) AS pm, stddev_samp(predicted_score) AS ps, count(*) AS n FROM vr GROUP BY 1, 2)"""


def validation_rows(spark, sf):
    x = A.x_metrics(spark, sf)
    return x.join(A.subdir_labels(spark, sf), ["name", "subdir"]).withColumn("predicted_score", 50 + 20 * F.col("cosim_mean") + F.col("l2_mean"))


@check("d28_e3_name_validation", f"WITH {_NV}, rk AS (SELECT *, {avg_rank_sql('human_score', 'subdir', 'DESC')} AS hr, {avg_rank_sql('pm', 'subdir', 'DESC')} AS pr FROM nv) "
       f"SELECT subdir, name, {r('human_score')} AS human_score, {r('pm')} AS predicted_score_mean, {r('ps')} AS predicted_score_std, n AS n_validation_ids, "
       f"{r('hr')} AS human_rank, {r('pr')} AS predicted_rank, {r('pr - hr')} AS rank_difference, {r('abs(pr - hr)')} AS absolute_rank_difference FROM rk")
def d28(spark, sf):
    return tidy(E.name_validation(validation_rows(spark, sf), ["subdir"]))


def pairs_sql(src: str, group: str | None, extra: str = "") -> str:
    on = f"a.{group} = b.{group} AND " if group else ""
    g = f"a.{group}, " if group else ""
    return f"prs AS (SELECT {g}a.truth - b.truth AS dt, a.pred - b.pred AS dp FROM {src} a JOIN {src} b ON {on}a.name < b.name{extra})"


TAU = """(sum(CASE WHEN sign(dt) * sign(dp) > 0 THEN 1 ELSE 0 END) - sum(CASE WHEN sign(dt) * sign(dp) < 0 THEN 1 ELSE 0 END))
    / sqrt(CAST(count(*) - sum(CASE WHEN dt = 0 THEN 1 ELSE 0 END) AS DOUBLE) * (count(*) - sum(CASE WHEN dp = 0 THEN 1 ELSE 0 END)))"""


def points_sql(src: str, group: str) -> str:
    part = group or "1"
    sel = f"{group}, " if group else ""
    return f"""rks AS (SELECT *, {avg_rank_sql('truth', part)} AS rt, {avg_rank_sql('pred', part)} AS rp FROM {src}),
    pts AS (SELECT {sel}count(*) AS n, avg(abs(pred - truth)) AS mae, sqrt(avg((pred - truth) * (pred - truth))) AS rmse,
        corr(truth, pred) AS pearson, corr(rt, rp) AS spearman FROM rks {f'GROUP BY {group}' if group else ''})"""


REG_SQL = f"""{A.SCORED}, sc AS (SELECT name, subdir, round(truth, 0) AS truth, round(pred, 1) AS pred FROM scored), {points_sql('sc', 'subdir')}, {pairs_sql('sc', 'subdir')},
    pp AS (SELECT subdir, {TAU} AS tau, avg(CASE WHEN abs(dt) > 3.5 THEN CASE WHEN sign(dt) = sign(dp) THEN 1.0 ELSE 0.0 END END) AS acc FROM prs GROUP BY 1)"""


@check("d18_d22_regression_metrics", f"WITH {REG_SQL} SELECT pts.subdir, n, {r('mae')} AS mae, {r('rmse')} AS rmse, {r('pearson')} AS pearson, {r('spearman')} AS spearman, "
       f"{r('tau')} AS kendall_tau, {r('acc')} AS pairwise_ranking_accuracy FROM pts JOIN pp ON pp.subdir = pts.subdir")
def d18(spark, sf):
    """Blocks are small here, so that many block pairs take part."""
    s = A.scored(spark, sf).withColumns({"truth": F.round("truth", 0), "pred": F.round("pred", 1)})
    return tidy(E.regression_metrics(s, ["subdir"], "name", "truth", "pred", gap=3.5))


@check("d19_pearson_constant", "SELECT CAST(l_linenumber AS BIGINT) AS line, CAST(NULL AS DOUBLE) AS pearson, count(*) AS n FROM lineitem GROUP BY 1")
def d19(spark, sf):
    """A constant side gives NULL, not an error."""
    li = A.load(spark, sf, "lineitem")
    return tidy(li.groupBy(F.col("l_linenumber").alias("line")).agg(
        E._correlation(F.col("l_linenumber").cast("double"), F.col("l_quantity")).alias("pearson"), F.count(F.lit(1)).alias("n")))


_SIG = "1.0 / (1.0 + exp(-0.693 * {}))"
OV_PAIR = f"""{A.SCORED_OV}, {points_sql('scored_ov', '')}, {pairs_sql('scored_ov', None)},
    far AS (SELECT *, {_SIG.format('dt')} AS tg, greatest(least({_SIG.format('dp')}, 1 - 1e-7), 1e-7) AS pb FROM prs WHERE abs(dt) >= 2.0),
    pp AS (SELECT avg(CASE WHEN sign(dt) = sign(dp) THEN 1.0 ELSE 0.0 END) AS acc, avg((pb - tg) * (pb - tg)) AS brier,
        -avg(tg * ln(pb) + (1 - tg) * ln(1 - pb)) AS ll, count(*) AS np FROM far), tt AS (SELECT {TAU} AS tau FROM prs)"""


@check("d23_overall_pair_metrics", f"WITH {OV_PAIR} SELECT n, {r('mae')} AS mae, {r('rmse')} AS rmse, {r('pearson')} AS pearson, {r('spearman')} AS spearman, {r('tau')} AS kendall_tau, "
       f"{r('acc')} AS pairwise_ranking_accuracy, {r('brier')} AS pairwise_brier_score, {r('ll')} AS pairwise_log_loss, np AS n_pairs FROM pts, pp, tt")
def d23(spark, sf):
    return tidy(E.overall_metrics(A.scored_overall(spark, sf), [], "name", "truth", "pred", block_rows=32))


_PREF = "1.0 / (1.0 + exp(-greatest(least(ln(0.8 / (1.0 - 0.8)) / 1.0 * {}, 50.0), -50.0)))"
TIE_SQL = f"""{A.SCORED}, {pairs_sql('scored', 'subdir')}, pb AS (SELECT *, {_PREF.format('dt')} AS pt, {_PREF.format('dp')} AS pq FROM prs)"""


@check("d24_tie_pair_metrics", f"WITH {TIE_SQL} SELECT {r('avg(CASE WHEN abs(dt) > 1 THEN CASE WHEN sign(dt) = sign(dp) THEN 1.0 ELSE 0.0 END END)')} AS pairwise_accuracy_over_margin, "
       f"count(*) FILTER (abs(dt) > 1) AS num_ordered_pairs, {r('avg(CASE WHEN abs(dt) <= 1 THEN CASE WHEN abs(dp) <= 1 THEN 1.0 ELSE 0.0 END END)')} AS tie_accuracy, "
       f"count(*) FILTER (abs(dt) <= 1) AS num_tie_pairs, {r('avg((pt - pq) * (pt - pq))')} AS pairwise_brier, "
       f"{r('-avg(pt * ln(greatest(least(pq, 1 - 1e-8), 1e-8)) + (1 - pt) * ln(1 - greatest(least(pq, 1 - 1e-8), 1e-8)))')} AS pairwise_log_loss FROM pb")
def d24(spark, sf):
    return tidy(E.tie_pair_metrics(A.scored(spark, sf), "name", "truth", "pred", "subdir", block_rows=32))


@check("d25_selection_loss", f"WITH {REG_SQL} SELECT pts.subdir, {r('coalesce(mae, 100) + 20 * (1 - coalesce(spearman, 0)) + 10 * (1 - coalesce(acc, 0.5))')} AS selection_loss "
       "FROM pts JOIN pp ON pp.subdir = pts.subdir")
def d25(spark, sf):
    s = A.scored(spark, sf).withColumns({"truth": F.round("truth", 0), "pred": F.round("pred", 1)})
    return tidy(E.selection_loss(E.regression_metrics(s, ["subdir"], "name", "truth", "pred", gap=3.5)).select("subdir", "selection_loss"))


@check("d25_overall_selection_loss", f"WITH {OV_PAIR} SELECT {r('mae + 20 * (1 - spearman) + 10 * (1 - acc) + 20 * brier + 2 * ll')} AS selection_loss FROM pts, pp, tt")
def d25o(spark, sf):
    return tidy(E.selection_loss(E.overall_metrics(A.scored_overall(spark, sf), [], "name", "truth", "pred"), overall=True).select("selection_loss"))


# --- candidates ---------------------------------------------------------------
CAND = """cand AS (SELECT l_returnflag AS subdir, l_linenumber AS spec_idx, CASE WHEN l_linenumber > 4 THEN 'full' WHEN l_linenumber > 2 THEN 'stability' ELSE 'primary' END AS variant,
    CAST(CASE WHEN l_linenumber % 2 = 0 THEN 10 ELSE 1 END AS DOUBLE) AS alpha, CASE WHEN l_linenumber > 5 THEN 0.1 ELSE 0.0 END AS gamma,
    round(avg(l_quantity), 0) AS selection_loss, avg(l_quantity) AS mae, avg(l_discount) * 10 AS spearman, avg(l_tax) * 10 AS pairwise_ranking_accuracy FROM lineitem GROUP BY 1, 2)"""


def candidates(spark, sf):
    n = F.col("l_linenumber")
    return A.load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("subdir"), n.alias("spec_idx")).agg(
        F.round(F.avg("l_quantity"), 0).alias("selection_loss"), F.avg("l_quantity").alias("mae"),
        (F.avg("l_discount") * 10).alias("spearman"), (F.avg("l_tax") * 10).alias("pairwise_ranking_accuracy"),
    ).withColumns({
        "variant": F.when(F.col("spec_idx") > 4, "full").when(F.col("spec_idx") > 2, "stability").otherwise("primary"),
        "alpha": F.when(F.pmod("spec_idx", F.lit(2)) == 0, 10.0).otherwise(1.0), "gamma": F.when(F.col("spec_idx") > 5, 0.1).otherwise(0.0)})


@check("e8_best_candidate", f"WITH {CAND} SELECT subdir, variant, CAST(spec_idx AS BIGINT) AS spec_idx, {r('selection_loss')} AS selection_loss FROM "
       "(SELECT *, row_number() OVER (PARTITION BY subdir, variant ORDER BY selection_loss, alpha, gamma, spec_idx) AS k FROM cand) WHERE k = 1")
def e8(spark, sf):
    return tidy(best_candidate(candidates(spark, sf), ["subdir", "variant"], ["selection_loss", "alpha", "gamma", "spec_idx"]).select(
        "subdir", "variant", "spec_idx", "selection_loss"))


@check("e8_modal_spec", "SELECT o_orderstatus AS spec, count(*) AS votes, min(o_orderkey) AS first_fold FROM orders GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 1")
def e8m(spark, sf):
    o = A.load(spark, sf, "orders").select(F.col("o_orderstatus").alias("spec"), "o_orderkey")
    return tidy(modal_spec(o, ["spec"], "o_orderkey"))


@check("d33_ablation", f"WITH {CAND} SELECT subdir, variant, CAST(spec_idx AS BIGINT) AS spec_idx, CAST(spec_idx = 2 AS BIGINT) AS selected_for_final FROM "
       "(SELECT *, row_number() OVER (PARTITION BY subdir, variant ORDER BY selection_loss, alpha, gamma, spec_idx) AS k FROM cand) WHERE k = 1")
def d33(spark, sf):
    from hearken.plans.selection import ablation

    c = candidates(spark, sf)
    chosen = c.filter("spec_idx = 2").select("subdir", F.col("spec_idx").alias("selected_idx"))
    return tidy(ablation(c, chosen, ["subdir"]).select("subdir", "variant", "spec_idx", "selected_for_final"))


J6 = f"""{CAND}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subdir, grp ORDER BY selection_loss, alpha, gamma, spec_idx) AS k
    FROM (SELECT *, CASE WHEN variant <> 'full' THEN 'base' WHEN gamma > 0 THEN 'aux' END AS grp FROM cand) WHERE grp IS NOT NULL) WHERE k = 1),
    duel AS (SELECT b.subdir, b.spec_idx AS bi, a.spec_idx AS ai,
        a.mae <= b.mae + 0.5 AND coalesce(a.spearman, 0) >= coalesce(b.spearman, 0) - 0.01 AND coalesce(a.pairwise_ranking_accuracy, 0.5) >= coalesce(b.pairwise_ranking_accuracy, 0.5) - 0.01
        AND (a.mae <= b.mae - 0.5 OR coalesce(a.spearman, 0) >= coalesce(b.spearman, 0) + 0.01 OR coalesce(a.pairwise_ranking_accuracy, 0.5) >= coalesce(b.pairwise_ranking_accuracy, 0.5) + 0.01)
        AND a.selection_loss < b.selection_loss AS ok FROM (SELECT * FROM best WHERE grp = 'base') b LEFT JOIN (SELECT * FROM best WHERE grp = 'aux') a ON a.subdir = b.subdir)"""


@check("j6_select_candidate", f"WITH {J6} SELECT subdir, CAST(CASE WHEN ok THEN ai ELSE bi END AS BIGINT) AS spec_idx, CAST(coalesce(ok, FALSE) AS BIGINT) AS auxiliary_accepted FROM duel")
def j6(spark, sf):
    from hearken.plans.selection import select_candidate

    return tidy(select_candidate(candidates(spark, sf), ["subdir"]).select("subdir", "spec_idx", "auxiliary_accepted"))


# --- ranking ------------------------------------------------------------------
PRED = "pred AS (SELECT name, pred + 6 AS p FROM scored_ov), known AS (SELECT name AS known, truth AS s FROM scored_ov)"
NEIGH = f"""{A.SCORED_OV}, {PRED}, dv AS (SELECT p.name, p.p, k.known, k.s FROM pred p LEFT JOIN known k ON k.known <> p.name)"""


def ranked_inputs(spark, sf):
    s = A.scored_overall(spark, sf)
    pred = s.select("name", (F.col("pred") + 6).alias("prediction"))
    known = s.select(F.col("name").alias("known"), F.col("truth").alias("score"))
    return pred, known


@check("c9_e4_f1_f2_neighbours", f"WITH {NEIGH} SELECT name, {r('p')} AS prediction, 1 + count(*) FILTER (s > p) AS estimated_rank, count(known) + 1 AS ranking_population, "
       "count(known) AS known_devices, coalesce(arg_min(known, (s, known)) FILTER (s >= p + 2.0), '') AS nearest_clearly_better, "
       "coalesce(arg_max(known, s) FILTER (s <= p - 2.0), '') AS nearest_clearly_worse, "
       "coalesce(string_agg(known, '|' ORDER BY abs(s - p), known) FILTER (abs(s - p) < 2.0), '') AS approximately_equal_devices FROM dv GROUP BY name, p")
def c9(spark, sf):
    pred, known = ranked_inputs(spark, sf)
    return tidy(R.neighbours(pred, known))


@check("c7_pairwise_probability", f"WITH {NEIGH} SELECT name, known AS known_device, {r('s')} AS known_human_score, {r('p')} AS new_overall_prediction, "
       f"{r('1.0 / (1.0 + exp(-0.693 * (p - s)))')} AS probability_new_better FROM dv")
def c7(spark, sf):
    pred, known = ranked_inputs(spark, sf)
    return tidy(R.pairwise_probability(pred, known))


@check("j17_rank_against_reference", f"WITH {A.SCORED}, dv AS (SELECT p.subdir, p.name, p.pred AS p, k.name AS known, k.truth AS s FROM scored p JOIN scored k ON k.subdir = p.subdir) "
       f"SELECT subdir, name, {r('p')} AS predicted_score, 1 + count(*) FILTER (s > p) AS estimated_rank, count(*) AS reference_device_count, "
       "coalesce(arg_min(known, (s, known)) FILTER (s > p + 1.0), '') AS nearest_clearly_better_device, coalesce(arg_max(known, s) FILTER (s < p - 1.0), '') AS nearest_clearly_worse_device, "
       "coalesce(string_agg(known, '|' ORDER BY s DESC, known) FILTER (abs(s - p) <= 1.0), '') AS similar_devices_within_margin FROM dv GROUP BY 1, 2, p")
def j17(spark, sf):
    s = A.scored(spark, sf)
    pred = s.select("subdir", "name", F.col("pred").alias("prediction"))
    known = s.select("subdir", F.col("name").alias("known"), F.col("truth").alias("score"))
    return tidy(R.rank_against_reference(pred, known, "subdir"))


@check("f5_sorted_summary", f"WITH {REG_SQL} SELECT pts.subdir, {r('spearman')} AS spearman, row_number() OVER (ORDER BY spearman DESC NULLS LAST) AS position FROM pts")
def f5(spark, sf):
    from hearken.plans.selection import sorted_summary

    s = A.scored(spark, sf).withColumns({"truth": F.round("truth", 0), "pred": F.round("pred", 1)})
    return tidy(sorted_summary(E.point_metrics(s, ["subdir"], "truth", "pred"), "spearman").select("subdir", "spearman", "position"))
