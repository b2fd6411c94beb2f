"""Roll-ups, normalisation, aggregation with uncertainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as A
from checks.registry import check, r, rnd, tidy
from hearken.config import METRICS
from hearken.operators.aggregate import aggregate_x, missing_subdirs, stage2_features
from hearken.operators.normalize import (
    apply_normalization, expected_items, fit_normalization, normalization_table, stabilise,
)
from hearken.operators.rollup import windows_to_x, windows_to_x_metrics, x_to_device_subdir

WIN_M = ("kl_mean", "kl_var", "js_mean", "js_var", "l2", "cos_sim")
OPT_M = WIN_M + ("l2_var", "cos_sim_var")


def _x_sql(metrics, pooled, keys):
    parts = [*keys, "count(*) AS n_windows", "string_agg(DISTINCT test_file, '|' ORDER BY test_file) AS test_files"]
    for c in metrics:
        parts += [
            f"{r(f'avg({c})')} AS {c}_audio_mean", f"{r(f'quantile_cont({c}, 0.5)')} AS {c}_audio_median",
            f"{r(f'coalesce(stddev_samp({c}), 0)')} AS {c}_audio_std", f"{r(f'min({c})')} AS {c}_audio_min",
            f"{r(f'max({c})')} AS {c}_audio_max", f"{r(f'max({c}) - min({c})')} AS {c}_audio_range",
        ]
    for p, m, v in pooled:
        parts += [f"{r(f'avg({m})')} AS {p}_pooled_audio_mean", f"{r(f'greatest(avg({v} + {m} * {m}) - avg({m}) * avg({m}), 0)')} AS {p}_pooled_audio_var"]
    return f"SELECT {', '.join(parts)} FROM windows GROUP BY {', '.join(keys)}"


KL_JS = (("kl", "kl_mean", "kl_var"), ("js", "js_mean", "js_var"))
ALL_POOLED = KL_JS + (("l2", "l2", "l2_var"), ("cos_sim", "cos_sim", "cos_sim_var"))
KEYS4 = ("name", "subdir", "audio_index", "original_file")


@check("d1_windows_to_x", f"WITH {A.WINDOWS} {_x_sql(WIN_M, KL_JS, KEYS4)}")
def d1(spark, sf):
    return tidy(windows_to_x(A.windows(spark, sf)))


@check("d1_hot_groups", f"WITH {A.WINDOWS}, w2 AS (SELECT subdir, kl_mean, l2 FROM windows) "
       f"SELECT subdir, count(*) AS n, {r('quantile_cont(l2, 0.5)')} AS l2_median, {r('quantile_cont(l2, 0.95)')} AS l2_p95, "
       f"{r('quantile_cont(kl_mean, 0.25)')} AS kl_p25 FROM w2 GROUP BY 1")
def d1_hot(spark, sf):
    """Quantiles of very large groups through prefix counts; the limit is low so that the path is taken."""
    from hearken.operators.skew import aggregate_with_quantiles

    out = aggregate_with_quantiles(
        A.windows(spark, sf), ["subdir"], [F.count(F.lit(1)).alias("n")],
        {"l2_median": ("l2", 0.5), "l2_p95": ("l2", 0.95), "kl_p25": ("kl_mean", 0.25)}, limit=1000)
    return tidy(out)


@check("d2_pooled_mean_var", f"WITH {A.WINDOWS} SELECT name, subdir, {r('avg(kl_mean)')} AS m, "
       f"{r('greatest(avg(kl_var + kl_mean * kl_mean) - avg(kl_mean) * avg(kl_mean), 0)')} AS v FROM windows GROUP BY 1, 2")
def d2(spark, sf):
    from hearken.operators.rollup import pooled_mean_var

    m, v = pooled_mean_var(F.col("kl_mean"), F.col("kl_var"))
    return tidy(A.windows(spark, sf).groupBy("name", "subdir").agg(m.alias("m"), v.alias("v")))


def _dev_sql(features):
    parts = ["name", "subdir", "count(*) AS n_audio", "CAST(sum(n_windows) AS BIGINT) AS n_windows_total"]
    for c in features:
        parts += [
            f"{r(f'avg({c})')} AS {c}_device_mean", f"{r(f'quantile_cont({c}, 0.5)')} AS {c}_device_median",
            f"{r(f'coalesce(stddev_samp({c}), 0)')} AS {c}_between_audio_std",
            f"{r(f'coalesce(stddev_samp({c}), 0) / sqrt(count({c}))')} AS {c}_standard_error",
        ]
    return f"SELECT {', '.join(parts)} FROM ax GROUP BY 1, 2"


AX = """ax AS (SELECT name, subdir, audio_index, count(*) AS n_windows, avg(kl_mean) AS kl_pooled_audio_mean,
    greatest(avg(kl_var + kl_mean * kl_mean) - avg(kl_mean) * avg(kl_mean), 0) AS kl_pooled_audio_var,
    quantile_cont(l2, 0.5) AS l2_audio_median, quantile_cont(cos_sim, 0.5) AS cos_sim_audio_median,
    coalesce(stddev_samp(l2), 0) AS l2_audio_std FROM windows GROUP BY 1, 2, 3, original_file)"""
DEV_FEATURES = ("kl_pooled_audio_mean", "kl_pooled_audio_var", "l2_audio_median", "cos_sim_audio_median", "l2_audio_std")


@check("d3_x_to_device_subdir", f"WITH {A.WINDOWS}, {AX} {_dev_sql(DEV_FEATURES)}")
def d3(spark, sf):
    return tidy(x_to_device_subdir(windows_to_x(A.windows(spark, sf)), DEV_FEATURES))


@check("d4_windows_to_x_optional", f"WITH {A.WINDOWS} {_x_sql(OPT_M, ALL_POOLED, KEYS4[:3])}")
def d4(spark, sf):
    return tidy(windows_to_x(A.windows(spark, sf).drop("original_file"), optional=True))


@check("d34_windows_to_x_metrics", f"WITH {A.XM} SELECT name, subdir, x, n_windows, "
       + ", ".join(f"{r(c)} AS {c}" for m in METRICS for c in (m.mean, m.var)) + " FROM xm")
def d34(spark, sf):
    return tidy(windows_to_x_metrics(A.windows(spark, sf)))


# --- normalisation -----------------------------------------------------------
_T = {
    "l2": ("ln(1 + greatest(l2_mean, 0))", "greatest(l2_var, 0) / pow(1 + greatest(l2_mean, 0), 2)"),
    "kl": ("ln(1 + greatest(kl_mean, 0))", "greatest(kl_var, 0) / pow(1 + greatest(kl_mean, 0), 2)"),
    "js": ("ln(1 + greatest(js_mean, 0))", "greatest(js_var, 0) / pow(1 + greatest(js_mean, 0), 2)"),
    "cosim": ("atanh(greatest(least(cosim_mean, 0.999999), -0.999999))",
              "greatest(cosim_var, 0) * pow(1.0 / greatest(1 - pow(greatest(least(cosim_mean, 0.999999), -0.999999), 2), 1e-8), 2)"),
}
DIR = {m.key: m.direction for m in METRICS}
KEYS = [m.key for m in METRICS]
STAB = "st AS (SELECT *, greatest(1.0, (n_windows + 4) / 5.0) AS n_effective, " + ", ".join(
    f"{t} AS {k}_t, {v} AS {k}_tv" for k, (t, v) in _T.items()) + " FROM xm)"


def robust_sql(src: str, keys: str, out: str) -> str:
    """CTEs with the centre and scale cascade of each metric for groups ``keys`` of ``src`` (a long table with m, t)."""
    return f"""{out}_c AS (SELECT {keys}, m, quantile_cont(t, 0.5) AS center, quantile_cont(t, 0.25) AS q25,
        quantile_cont(t, 0.75) AS q75, stddev_samp(t) AS sd, count(t) AS n FROM {src} GROUP BY {keys}, m),
    {out}_d AS (SELECT {', '.join('l.' + k.strip() for k in keys.split(','))}, l.m, quantile_cont(abs(l.t - c.center), 0.5) AS mad
        FROM {src} l JOIN {out}_c c ON {' AND '.join(f'l.{k.strip()} = c.{k.strip()}' for k in keys.split(','))} AND l.m = c.m GROUP BY ALL),
    {out} AS (SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, c.m, c.center, c.n,
        CASE WHEN 1.4826 * d.mad > 1e-8 THEN 1.4826 * d.mad WHEN c.n >= 2 AND (q75 - q25) / 1.349 > 1e-8 THEN (q75 - q25) / 1.349
             WHEN c.n >= 2 AND sd > 1e-8 THEN sd ELSE 1.0 END AS scale,
        CASE WHEN 1.4826 * d.mad > 1e-8 THEN 'mad' WHEN c.n >= 2 AND (q75 - q25) / 1.349 > 1e-8 THEN 'iqr'
             WHEN c.n >= 2 AND sd > 1e-8 THEN 'std' ELSE 'constant' END AS method
        FROM {out}_c c JOIN {out}_d d ON {' AND '.join(f'c.{k.strip()} = d.{k.strip()}' for k in keys.split(','))} AND c.m = d.m)"""


LONG = "lx AS (" + " UNION ALL ".join(
    f"SELECT name, subdir, x, n_windows, n_effective, '{k}' AS m, {k}_t AS t, {k}_tv AS tv, {DIR[k]} AS dir FROM st" for k in KEYS) + ")"
LEVELS = """lv AS (SELECT 'subdir_x' AS level, subdir, x, m, t FROM lx UNION ALL SELECT 'subdir_fallback', subdir, '', m, t FROM lx
    UNION ALL SELECT 'global_fallback', '', '', m, t FROM lx)"""
STATS = f"{A.XM}, {STAB}, {LONG}, {LEVELS}, {robust_sql('lv', 'level, subdir, x', 'stats')}"


@check("b12_effective_sample_size", f"WITH {A.XM} SELECT name, subdir, x, {r('greatest(1.0, (n_windows + 4) / 5.0)')} AS n_effective FROM xm")
def b12(spark, sf):
    return tidy(stabilise(A.x_metrics(spark, sf)).select("name", "subdir", "x", "n_effective"))


@check("b13_stabilising_transform", f"WITH {A.XM}, {STAB} SELECT name, subdir, x, " + ", ".join(
    f"{r(f'{k}_t')} AS {k}_t, {r(f'{k}_tv')} AS {k}_tv" for k in KEYS) + " FROM st")
def b13(spark, sf):
    return tidy(stabilise(A.x_metrics(spark, sf)).select("name", "subdir", "x", *[c for k in KEYS for c in (f"{k}_t", f"{k}_tv")]))


@check("d5_robust_center_scale", f"WITH {A.WINDOWS}, lw AS (SELECT name, subdir, 'l2' AS m, l2 AS t FROM windows UNION ALL SELECT name, subdir, 'js', js_mean FROM windows), "
       f"{robust_sql('lw', 'name, subdir', 's')} SELECT name, subdir, m AS metric, {r('center')} AS center, {r('scale')} AS scale, method, n AS count FROM s")
def d5(spark, sf):
    from hearken.operators.normalize import robust_stats

    w = A.windows(spark, sf).select("name", "subdir", F.col("l2"), F.col("js_mean").alias("js"))
    s = robust_stats(w, ["name", "subdir"], ["l2", "js"])
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}__{c}").alias(c) for c in ("center", "scale", "method", "count")]) for m in ("l2", "js")]))
    return tidy(s.select("name", "subdir", long.alias("e")).select("name", "subdir", "e.*"))


@check("d5_hot_groups", f"WITH {A.WINDOWS}, lw AS (SELECT subdir, 'l2' AS m, l2 AS t FROM windows), "
       f"{robust_sql('lw', 'subdir', 's')} SELECT subdir, {r('center')} AS center, {r('scale')} AS scale, method, n AS count FROM s")
def d5_hot(spark, sf):
    """Same statistics with every group on the large-group path."""
    from hearken.operators.normalize import robust_stats

    s = robust_stats(A.windows(spark, sf).select("subdir", "l2"), ["subdir"], ["l2"], limit=1000)
    return tidy(s.select("subdir", *[F.col(f"l2__{c}").alias(c) for c in ("center", "scale", "method", "count")]))


@check("d6_normalization_stats", f"WITH {STATS} SELECT level, subdir, x, m AS metric, {r('center')} AS center, {r('scale')} AS scale, method, "
       "n AS count FROM stats WHERE level <> 'global_fallback'")
def d6(spark, sf):
    return tidy(normalization_table(fit_normalization(A.x_metrics(spark, sf))))


@check("d7_expected_items", f"WITH {A.XM} SELECT subdir, count(DISTINCT x) AS expected_x FROM xm GROUP BY 1")
def d7(spark, sf):
    return tidy(expected_items(A.x_metrics(spark, sf)))


# Statistics are fitted on even-tempered devices only (rated ones), so unrated devices meet fallbacks.
FIT_SQL = f"{A.XM}, {A.OV}, {STAB}, fitx AS (SELECT st.* FROM st WHERE name IN (SELECT name FROM ov)), " + LONG.replace("FROM st", "FROM fitx") + \
    f", {LEVELS}, {robust_sql('lv', 'level, subdir, x', 'stats')}, " + LONG.replace("lx AS", "la AS") + f""",
    nz AS (SELECT la.name, la.subdir, la.x, la.n_windows, la.m,
        CASE WHEN a.center IS NOT NULL THEN 'subdir_x' WHEN b.center IS NOT NULL THEN 'subdir_fallback' ELSE 'global_fallback' END AS level,
        dir * (t - coalesce(a.center, b.center, c.center)) / coalesce(a.scale, b.scale, c.scale) AS q,
        sqrt(tv / n_effective) / coalesce(a.scale, b.scale, c.scale) AS se, coalesce(a.method, b.method, c.method) AS method
        FROM la LEFT JOIN stats a ON a.level = 'subdir_x' AND a.subdir = la.subdir AND a.x = la.x AND a.m = la.m
        LEFT JOIN stats b ON b.level = 'subdir_fallback' AND b.subdir = la.subdir AND b.m = la.m
        LEFT JOIN stats c ON c.level = 'global_fallback' AND c.m = la.m),
    ex AS (SELECT subdir, count(DISTINCT x) AS expected_x FROM fitx GROUP BY 1)"""


def rated_fit(spark, sf):
    x = A.x_metrics(spark, sf)
    fit = x.join(A.overall_labels(spark, sf).select("name"), "name", "left_semi")
    return x, fit


@check("c5_apply_normalization", f"WITH {FIT_SQL} SELECT name, subdir, x, " + ", ".join(
    f"{r(f'max(CASE WHEN m = {chr(39)}{k}{chr(39)} THEN q END)')} AS {k}_quality, {r(f'max(CASE WHEN m = {chr(39)}{k}{chr(39)} THEN se END)')} AS {k}_within_se, "
    f"max(CASE WHEN m = '{k}' THEN level END) AS {k}_normalization_level, max(CASE WHEN m = '{k}' THEN method END) AS {k}_normalization_method" for k in KEYS)
    + " FROM nz GROUP BY 1, 2, 3")
def c5(spark, sf):
    x, fit = rated_fit(spark, sf)
    out = apply_normalization(x, fit_normalization(fit))
    return tidy(out.select("name", "subdir", "x", *[f"{k}_{s}" for k in KEYS for s in ("quality", "within_se", "normalization_level", "normalization_method")]))


AGG_SQL = f"""{FIT_SQL}, ag AS (SELECT nz.name, nz.subdir, m, count(*) AS n_x, count(DISTINCT x) AS n_unique_x, CAST(sum(n_windows) AS BIGINT) AS n_windows_total,
    max(expected_x) AS expected_x, avg(q) AS qm, quantile_cont(q, 0.5) AS qmed, stddev_samp(q) AS sd, avg(se) AS sem, sum(se * se) AS se2,
    max(CASE WHEN level <> 'subdir_x' THEN 1 ELSE 0 END) AS fb FROM nz LEFT JOIN ex ON ex.subdir = nz.subdir GROUP BY 1, 2, 3),
    ag2 AS (SELECT *, CASE WHEN expected_x > 0 THEN least(1.0, CAST(n_unique_x AS DOUBLE) / expected_x) END AS cov,
        sqrt(se2 / (n_x * n_x) + coalesce(sd * sd / n_x, 0)) AS tse FROM ag),
    agg AS (SELECT name, subdir, max(n_x) AS n_x, max(n_unique_x) AS n_unique_x, max(coalesce(expected_x, 0)) AS expected_x, max(cov) AS coverage_ratio,
        max(n_windows_total) AS n_windows_total, max(fb) AS fb, """ + ", ".join(
    ", ".join(f"max(CASE WHEN m = '{k}' THEN {e} END) AS {k}_{n}" for n, e in (
        ("quality_mean", "qm"), ("quality_median", "qmed"), ("between_x_std", "sd"), ("between_x_se", "sd / sqrt(n_x)"), ("within_se_mean", "sem"),
        ("total_se", "tse"), ("stability_quality", "-sd"), ("uncertainty_quality", "-tse"))) for k in KEYS) + """ FROM ag2 GROUP BY 1, 2),
    aggregated AS (SELECT *, least(greatest(sqrt(least(n_x, 3) / 3.0) * coalesce(sqrt(coverage_ratio), 0.5), 0.25), 1.0) AS reliability_weight,
        concat_ws('|', CASE WHEN n_x = 1 THEN 'single_x_within_only' END, CASE WHEN coverage_ratio < 1 THEN 'partial_x_coverage' END,
            CASE WHEN fb = 1 THEN 'normalization_fallback' END) AS reliability_warning FROM agg)"""
_PER = ("quality_mean", "quality_median", "between_x_std", "between_x_se", "within_se_mean", "total_se", "stability_quality", "uncertainty_quality")


@check("d8_aggregate_uncertainty", f"WITH {AGG_SQL} SELECT name, subdir, n_x, n_unique_x, expected_x, {r('coverage_ratio')} AS coverage_ratio, n_windows_total, "
       "CAST(n_x >= 2 AS BIGINT) AS has_multiple_x, CASE WHEN n_x >= 2 THEN 'between_and_within' ELSE 'within_only' END AS uncertainty_mode, "
       + ", ".join(f"{r(f'{k}_{s}')} AS {k}_{s}" for k in KEYS for s in _PER)
       + f", {r('reliability_weight')} AS reliability_weight, CAST(fb AS BIGINT) AS normalization_fallback_used, reliability_warning FROM aggregated")
def d8(spark, sf):
    x, fit = rated_fit(spark, sf)
    return tidy(aggregate_x(apply_normalization(x, fit_normalization(fit)), expected_items(fit)))


@check("d9_d11_reliability_and_warnings", f"WITH {AGG_SQL} SELECT reliability_warning, n_x, {r('reliability_weight')} AS reliability_weight, count(*) AS n FROM aggregated GROUP BY 1, 2, 3")
def d9(spark, sf):
    x, fit = rated_fit(spark, sf)
    agg = aggregate_x(apply_normalization(x, fit_normalization(fit)), expected_items(fit))
    return tidy(agg.groupBy("reliability_warning", "n_x", rnd("reliability_weight").alias("reliability_weight")).agg(F.count(F.lit(1)).alias("n")))


@check("d10_old_reliability_weights", f"WITH {A.XM}, a AS (SELECT name, subdir, count(*) AS n_audio FROM xm GROUP BY 1, 2) "
       f"SELECT name, subdir, {r('sqrt(least(greatest(n_audio, 1), 5)) / avg(sqrt(least(greatest(n_audio, 1), 5))) OVER ()')} AS weight FROM a")
def d10(spark, sf):
    from hearken.plans.windowed import reliability_weights

    a = A.x_metrics(spark, sf).groupBy("name", "subdir").agg(F.count(F.lit(1)).alias("n_audio"))
    return tidy(reliability_weights(a).select("name", "subdir", "weight"))


_S2 = """pr AS (SELECT name, subdir, least(greatest(50 + 9 * l2_quality_mean + 4 * cosim_quality_mean, 0), 100) AS p, reliability_weight AS w, reliability_warning AS t
    FROM aggregated WHERE NOT (subdir = 'R' AND n_unique_x < 38)),
    wide AS (SELECT name, """ + ", ".join(
    f"avg(CASE WHEN subdir = '{s}' THEN p END) AS q{s}, avg(CASE WHEN subdir = '{s}' THEN w END) AS r{s}, coalesce(min(CASE WHEN subdir = '{s}' THEN t END), 'missing_subdir') AS w{s}"
    for s in "ANR") + """ FROM pr GROUP BY 1),
    s2 AS (SELECT *, least(greatest((CAST(qA IS NOT NULL AS INT) + CAST(qN IS NOT NULL AS INT) + CAST(qR IS NOT NULL AS INT)) / 3.0
        * coalesce((coalesce(rA, 0) + coalesce(rN, 0) + coalesce(rR, 0)) / nullif(CAST(rA IS NOT NULL AS INT) + CAST(rN IS NOT NULL AS INT) + CAST(rR IS NOT NULL AS INT), 0), 0.25), 0.1), 1.0) AS rel FROM wide)"""


def _stage2(spark, sf):
    """Closed-form subdir predictions; devices with a thin task R count as missing it."""
    x, fit = rated_fit(spark, sf)
    agg = aggregate_x(apply_normalization(x, fit_normalization(fit)), expected_items(fit)).filter("NOT (subdir = 'R' AND n_unique_x < 38)")
    p = F.least(F.greatest(50 + 9 * F.col("l2_quality_mean") + 4 * F.col("cosim_quality_mean"), F.lit(0.0)), F.lit(100.0))
    return stage2_features(agg.withColumn("predicted_percentile", p), ["A", "N", "R"])


@check("d29_stage2_features", f"WITH {AGG_SQL}, {_S2} SELECT name, " + ", ".join(
    f"{r(f'q{s}')} AS q_{s}, {r(f'r{s}')} AS r_{s}, w{s} AS w_{s}" for s in "ANR") + f", {r('rel')} AS overall_reliability FROM s2")
def d29(spark, sf):
    f = _stage2(spark, sf)
    cols = [c for s in "ANR" for c in (F.col(f"`subdir::{s}`").alias(f"q_{s}"), F.col(f"`subdir::{s}__reliability`").alias(f"r_{s}"), F.col(f"`subdir::{s}__warning`").alias(f"w_{s}"))]
    return tidy(f.select("name", *cols, "overall_reliability"))


@check("g3_missing_subdirs", f"WITH {AGG_SQL}, {_S2} SELECT name, {r('1.0 - (CAST(qA IS NULL AS INT) + CAST(qN IS NULL AS INT) + CAST(qR IS NULL AS INT)) / 3.0')} AS subdir_coverage, "
       "concat_ws('|', CASE WHEN qA IS NULL OR qN IS NULL OR qR IS NULL THEN 'missing_subdirs=' || concat_ws(',', CASE WHEN qA IS NULL THEN 'A' END, "
       "CASE WHEN qN IS NULL THEN 'N' END, CASE WHEN qR IS NULL THEN 'R' END) END, CASE WHEN rel < 0.6 THEN 'low_overall_reliability' END) AS reliability_warning FROM s2")
def g3(spark, sf):
    return tidy(missing_subdirs(_stage2(spark, sf), ["A", "N", "R"]).select("name", "subdir_coverage", "reliability_warning"))
