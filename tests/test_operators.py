"""Operators on small tables with hand-made or brute-force expectations."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brute import center_scale, make_table
from hearken.functions.directions import metric_direction
from hearken.functions.solvers import solve_elastic, solve_nonneg
from hearken.operators import divergence as D
from hearken.operators import evaluation as E
from hearken.operators import quality as Q
from hearken.operators import ranking as R
from hearken.operators import series as S
from hearken.operators import skew as K
from hearken.operators import vectors as V
from hearken.operators.normalize import apply_normalization, fit_normalization, robust_stats
from hearken.operators.rollup import windows_to_x, windows_to_x_metrics, x_to_device_subdir
from hearken.plans.lattice import fold_map


def test_hot_path_equals_plain_path(spark):
    """One group holds most rows; ties, negatives, zero and NULL included."""
    rng = np.random.default_rng(1)
    rows = [("big", float(v)) for v in np.round(rng.normal(0, 3, 900), 1)] + [("small", float(v)) for v in rng.normal(5, 1, 40)] + [("big", None), ("big", 0.0), (None, 2.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {f"p{int(p*100)}": ("v", p) for p in (0.025, 0.25, 0.5, 0.9, 1.0)}
    aggs = [F.count("v").alias("n"), F.avg("v").alias("m")]
    a = K.aggregate_with_quantiles(df, ["g"], aggs, want, limit=100, distinct={"u": "v"}).orderBy("g").toPandas()
    b = K.aggregate_with_quantiles(df, ["g"], aggs, want, limit=None, distinct={"u": "v"}).orderBy("g").toPandas()
    pd.testing.assert_frame_equal(a[b.columns], b)
    g = K.aggregate_with_quantiles(df, [], aggs, want, limit=10).toPandas()
    assert len(g) == 1 and g.p50[0] == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_infinities_on_both_sides_of_the_limit(spark):
    inf = float("inf")
    groups = {"top": [1.0, 2.0, 3.0, inf], "low": [-inf, 1.0, 2.0, 3.0], "both": [-inf, -inf, 0.0, 5.0, inf], "ends": [-inf, inf], "all": [inf, inf, inf], "nan": [1.0, inf, float("nan")]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    want = {f"p{int(p*100)}": ("v", p) for p in (0.0, 0.1, 0.5, 0.9, 1.0)}
    plain, hot = (K.aggregate_with_quantiles(df, ["g"], [F.count("v").alias("n")], want, limit=n).orderBy("g").toPandas() for n in (None, 1))
    pd.testing.assert_frame_equal(hot[plain.columns], plain)
    by = plain.set_index("g")
    assert by.p50["top"] == 2.5 and by.p90["top"] == inf and by.p10["low"] == -inf and np.isnan(by.p50["ends"]) and by.p10["all"] == inf
    plain, hot = (robust_stats(df, ["g"], ["v"], n).orderBy("g").toPandas() for n in (None, 1))
    pd.testing.assert_frame_equal(hot[plain.columns], plain)


def test_robust_stats_cascade_both_paths(spark):
    groups = {"mad": [1, 2, 3, 4, 9], "iqr": [5, 5, 5, 5, 5, 6, 7, 8], "std": [2, 2, 2, 2, 2, 2, 2, 2, 9], "constant": [4, 4, 4], "lone": [3]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    for limit in (None, 2):
        got = {r["g"]: r for r in robust_stats(df, ["g"], ["v"], limit).collect()}
        for g, vs in groups.items():
            c, s = center_scale(vs)
            assert got[g]["v__center"] == pytest.approx(c) and got[g]["v__scale"] == pytest.approx(s)
            assert got[g]["v__method"] == {"lone": "constant"}.get(g, g) and got[g]["v__count"] == len(vs)


def test_ranks_and_prefix_counts(spark):
    v = [3.0, 1.0, 3.0, -2.0, 0.0, 3.0, 1e-9]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, i int, v double")
    want = pd.Series(v).rank(method="average").tolist()
    for bounded in (True, False):
        got = [r["rank"] for r in K.average_rank(df, ["k"], "v", bounded=bounded).orderBy("i").collect()]
        assert got == want
    pts = spark.createDataFrame([("a", 3.0), ("a", 2.0), ("a", -9.0), ("b", 1.0)], "k string, v double")
    c = {(r["k"], r["v"]): (r["n_lt"], r["n_le"], r["n_total"]) for r in K.counts_at(df.select("k", "v"), pts, ["k"], "v").collect()}
    assert c == {("a", 3.0): (4, 7, 7), ("a", 2.0): (4, 4, 7), ("a", -9.0): (0, 0, 7), ("b", 1.0): (0, 0, 0)}


def test_pair_metrics_brute_force(spark):
    rng = np.random.default_rng(2)
    t, p = np.round(rng.normal(50, 6, 60)), np.round(rng.normal(50, 6, 60))
    df = spark.createDataFrame([(f"n{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(t, p))], "name string, t double, p double")
    got = E.overall_metrics(df, [], "name", "t", "p", block_rows=7).first()
    pairs = list(itertools.combinations(range(60), 2))
    far = [(i, j) for i, j in pairs if abs(t[i] - t[j]) >= 2]
    sig = lambda z: 1 / (1 + np.exp(-0.693 * z))
    tg = np.array([sig(t[i] - t[j]) for i, j in far])
    pr = np.clip([sig(p[i] - p[j]) for i, j in far], 1e-7, 1 - 1e-7)
    assert got["n_pairs"] == len(far)
    assert got["pairwise_ranking_accuracy"] == pytest.approx(np.mean([np.sign(t[i] - t[j]) == np.sign(p[i] - p[j]) for i, j in far]))
    assert got["pairwise_brier_score"] == pytest.approx(np.mean((pr - tg) ** 2))
    assert got["pairwise_log_loss"] == pytest.approx(-np.mean(tg * np.log(pr) + (1 - tg) * np.log(1 - pr)))
    s = np.array([np.sign(t[i] - t[j]) * np.sign(p[i] - p[j]) for i, j in pairs])
    n1, n2 = (np.array([v[i] == v[j] for i, j in pairs]).sum() for v in (t, p))
    assert got["kendall_tau"] == pytest.approx(s.sum() / np.sqrt((len(pairs) - n1) * (len(pairs) - n2)))
    assert got["spearman"] == pytest.approx(np.corrcoef(pd.Series(t).rank(), pd.Series(p).rank())[0, 1])


def test_metric_edge_cases(spark):
    one = spark.createDataFrame([("a", 1.0, 2.0)], "name string, t double, p double")
    r = E.regression_metrics(one, [], "name", "t", "p").first()
    assert r["n"] == 1 and r["mae"] == 1.0 and r["pearson"] is None and r["kendall_tau"] is None and r["pairwise_ranking_accuracy"] is None
    flat = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 3.0), ("c", float("nan"), 1.0)], "name string, t double, p double")
    r = E.selection_loss(E.regression_metrics(flat, [], "name", "t", "p")).first()
    assert r["n"] == 2 and r["pearson"] is None and r["selection_loss"] == pytest.approx(1.5 + 20 + 5)
    # Gap boundary: a difference equal to the gap is skipped by the plain rule and kept by the overall rule.
    two = spark.createDataFrame([("a", 0.0, 0.0), ("b", 2.0, 1.0)], "name string, t double, p double")
    assert E.regression_metrics(two, [], "name", "t", "p", gap=2.0).first()["pairwise_ranking_accuracy"] is None
    assert E.overall_metrics(two, [], "name", "t", "p").first()["n_pairs"] == 1


def test_neighbours_against_loops(spark):
    rng = np.random.default_rng(4)
    known = {f"k{i:02d}": float(np.round(s, 1)) for i, s in enumerate(rng.uniform(40, 60, 40))}
    known["k05"] = known["k06"] = known["k07"]
    pred = {f"k{i:02d}": float(np.round(s, 1)) for i, s in zip(range(0, 40, 3), rng.uniform(38, 62, 14))} | {"new": 50.0, "top": 90.0, "low": 1.0}
    got = R.neighbours(spark.createDataFrame(list(pred.items()), "name string, prediction double"), spark.createDataFrame(list(known.items()), "known string, score double")).collect()
    assert len(got) == len(pred)
    for r in got:
        p = r["prediction"]
        others = {k: s for k, s in known.items() if k != r["name"]}
        assert r["estimated_rank"] == 1 + sum(s > p for s in others.values()) and r["ranking_population"] == len(others) + 1
        up = sorted((s, k) for k, s in others.items() if s >= p + 2)
        down = sorted((-s, k) for k, s in others.items() if s <= p - 2)
        assert r["nearest_clearly_better"] == (up[0][1] if up else "") and r["nearest_clearly_worse"] == (down[0][1] if down else "")
        near = sorted((abs(s - p), k) for k, s in others.items() if abs(s - p) < 2)
        assert r["approximately_equal_devices"] == "|".join(k for _, k in near)


def test_expected_win(spark):
    u = {"a": 1.0, "b": 0.2, "c": -3.0}
    df = spark.createDataFrame([("x", k, v) for k, v in u.items()] + [("y", "solo", 4.0)], "d string, name string, u double")
    got = {r["name"]: r["expected_pairwise_win_percent"] for r in R.expected_win(df, ["d"], "name", "u").collect()}
    for k, v in u.items():
        assert got[k] == pytest.approx(100 * np.mean([1 / (1 + np.exp(-(v - o))) for n, o in u.items() if n != k]))
    assert got["solo"] == 50.0
    two = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 9.0)], "d string, name string, u double")
    assert R.expected_win(two, ["d"], "name", "u").agg(F.sum("expected_pairwise_win_percent")).first()[0] == pytest.approx(100)


def test_divergence_full_and_topk(spark):
    p, q = {0: 0.5, 1: 0.5}, {0: 0.25, 2: 0.75}
    rows = [(1, s, 0, t, float(np.log(v))) for s, d in (("p", p), ("q", q)) for t, v in d.items()]
    df = spark.createDataFrame(rows, "pair_key int, side string, step int, token_id int, logprob double")
    r = D.divergence(df).first()
    assert r["kl_pq"] == pytest.approx(0.5 * np.log(2)) and r["kl_qp"] == pytest.approx(0.25 * np.log(0.5))
    m = {t: (p.get(t, 0) + q.get(t, 0)) / 2 for t in (0, 1, 2)}
    js = 0.5 * sum(v * np.log(v / m[t]) for t, v in p.items()) + 0.5 * sum(v * np.log(v / m[t]) for t, v in q.items())
    assert r["js"] == pytest.approx(js) and r["entropy_p"] == pytest.approx(np.log(2))
    part = df.filter("NOT (side = 'p' AND token_id = 1)")
    k = D.divergence_topk(part).first()
    a, b = np.array([0.5, 1e-12, 0.5]), np.array([0.25, 0.75, 1e-12])
    a, b = a / a.sum(), b / b.sum()
    assert k["kl_pq"] == pytest.approx(float(np.sum(a * np.log(a / b)))) and k["type"] == "topk_approx"
    mixed = spark.createDataFrame([(1, "full"), (1, "topk")], "pair_key int, kind string")
    with pytest.raises(ValueError, match="full and top-k"):
        D.require_same_kind(mixed)


def test_frechet_against_matrix_root(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(30, 4)), rng.normal(1, 2, size=(25, 4))
    df = spark.createDataFrame([("r", [float(v) for v in a]) for a in x] + [("t", [float(v) for v in a]) for a in y], "side string, embedding array<float>")
    got = V.frechet(df, "r", "t").first()
    x, y = x.astype(np.float32).astype(float), y.astype(np.float32).astype(float)
    cx, cy = np.cov(x.T) + 1e-6 * np.eye(4), np.cov(y.T) + 1e-6 * np.eye(4)
    lam = np.linalg.eigvals(cx @ cy)
    want = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(cx + cy) - 2 * np.sqrt(lam.real).sum()
    assert got["frechet_distance"] == pytest.approx(want, rel=1e-6)
    with pytest.raises(ValueError, match="at least two"):
        V.frechet(df.filter("side = 'r'"), "r", "t")


def direct_segments(db, thr, gap, hop, min_len, pad):
    runs, start = [], None
    for i, v in enumerate([*db, -999]):
        if v > thr and start is None:
            start = i
        elif v <= thr and start is not None:
            runs.append([start, i])
            start = None
    merged = []
    for a, b in runs:
        if merged and a - merged[-1][1] <= gap:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    out = [(max(0.0, a * hop - pad), min(len(db) * hop, b * hop + pad)) for a, b in merged]
    return [s for s in out if s[1] - s[0] >= min_len]


@pytest.mark.parametrize("chunk", [4, 1000])
def test_silence_segments(spark, chunk):
    rng = np.random.default_rng(8)
    db = np.where(rng.random(200) < 0.45, -10.0, -60.0)
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(db)], "k string, frame int, db double")
    got = [(r["segment_start"], r["segment_end"]) for r in S.silence_segments(df, ["k"], -40.0, 10.0, 2, 45.0, 8.0, chunk=chunk).orderBy("segment").collect()]
    assert got == direct_segments(db, -40.0, 2, 10.0, 45.0, 8.0)


def test_frames_and_lag(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=103)
    df = spark.createDataFrame([("r", i, float(x)) for i, x in enumerate(v)], "k string, i int, value double")
    got = [r["rms"] for r in S.frame_rms(df, ["k"], 20, 7).orderBy("frame").collect()]
    n = 1 + int(np.ceil((103 - 20) / 7))
    padded = np.pad(v, (0, (n - 1) * 7 + 20 - 103))
    assert np.allclose(got, [np.sqrt(np.mean(padded[f * 7 : f * 7 + 20] ** 2) + 1e-12) for f in range(n)])
    late = spark.createDataFrame([("r", i, float(x)) for i, x in enumerate(np.concatenate([rng.normal(size=6), v]))], "k string, i int, value double")
    lag = S.estimate_lag(df, late, ["k"], 15, scale=3.0)
    assert (lag.first()["lag"], lag.first()["lag_samples"]) == (6, 18)
    one = S.estimate_lag(df, late, ["k"], 15)
    al = S.align_by_lag(df, late, one, ["k"]).toPandas()
    assert len(al) == 103 and np.allclose(al.ref_value, al.test_value) and S.check_overlap(df, late, one, ["k"]).first()["overlap"] == 103


def test_frames_without_samples_have_a_row(spark):
    df = spark.createDataFrame([("r", 0, 1.0), ("r", 40, 2.0)], "k string, i int, value double")
    got = {r["frame"]: r["rms"] for r in S.frame_rms(df, ["k"], 4, 4).collect()}
    assert sorted(got) == list(range(11))
    assert np.allclose([got[f] for f in range(11)], [np.sqrt({0: 0.25, 10: 1.0}.get(f, 0.0) + 1e-12) for f in range(11)])


def test_join_of_two_aggregates_shuffles_twice(spark):
    df = spark.range(1000).selectExpr("id % 7 AS k", "id AS v")
    a, b = df.groupBy("k").agg(F.sum("v").alias("a")), df.groupBy("k").agg(F.max("v").alias("b"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = lambda **o: K.keyed_join(a, b, ["k"], **o).hint("merge")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert plan() <= 2 < plan(nulls=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_missing_numbers_never_reach_an_aggregate(spark):
    """NaN counts as missing in every roll-up, as text and as a number."""
    cols = "name string, subdir string, audio_index string, original_file string, kl_mean double, kl_var double, js_mean double, js_var double, l2 double, cos_sim double"
    df = spark.createDataFrame([("d", "s", "1", "f", 2.0, 1.0, 1.0, 1.0, 1.0, 0.5), ("d", "s", "1", "f", float("nan"), 1.0, float("nan"), 1.0, 3.0, 0.7)], cols)
    x = windows_to_x(df).first()
    assert (x.kl_mean_audio_mean, x.kl_mean_audio_median, x.kl_mean_audio_max, x.kl_mean_audio_std, x.n_windows) == (2.0, 2.0, 2.0, 0.0, 2)
    m = windows_to_x_metrics(df).first()
    assert (m.kl_mean, m.kl_var, m.l2_mean) == (2.0, 0.0, 2.0)
    items = spark.createDataFrame([("d", "s", "1", 3, 4.0), ("d", "s", "2", 3, float("nan"))], "name string, subdir string, audio_index string, n_windows int, f double")
    assert x_to_device_subdir(items, ["f"]).first().f_device_mean == 4.0
    assert Q.violations(spark.createDataFrame([("s", "d", "1", 2, *[float("nan")] * 2, *[0.5] * 6)], "subdir string, name string, x string, n_windows int, l2_mean double, l2_var double, cosim_mean double, cosim_var double, kl_mean double, kl_var double, js_mean double, js_var double")).select("rule").collect() == [("non_numeric",)]


def test_leave_one_out_has_no_limit_on_devices(spark):
    """More devices than any fixed number of folds."""
    folds = fold_map(spark.range(130).selectExpr("concat('d', id) AS name"), None)
    assert folds.count() == folds.select("fold").distinct().count() == 130


def test_rollup_single_window_and_nulls(spark):
    cols = "name string, subdir string, audio_index string, original_file string, kl_mean double, kl_var double, js_mean double, js_var double, l2 double, cos_sim double"
    rows = [("d", "s", "1", "f", 1.0, 0.1, None, 0.1, 2.0, 0.5), ("d", "s", "2", "f", 1.0, 0.2, 0.3, 0.1, 4.0, 0.1), ("d", "s", "2", "f", 3.0, None, 0.5, 0.1, 8.0, 0.3)]
    a = windows_to_x(spark.createDataFrame(rows, cols)).orderBy("audio_index").collect()
    assert a[0]["l2_audio_std"] == 0.0 and a[0]["js_mean_audio_mean"] is None and a[0]["js_mean_audio_std"] is None and a[0]["js_pooled_audio_mean"] is None
    assert a[1]["kl_pooled_audio_mean"] == 1.0 and a[1]["kl_pooled_audio_var"] == pytest.approx(0.2) and a[1]["kl_mean_audio_range"] == 2.0
    d = x_to_device_subdir(spark.createDataFrame(a), ["l2_audio_mean"]).first()
    assert d["n_audio"] == 2 and d["n_windows_total"] == 3 and d["l2_audio_mean_standard_error"] == pytest.approx(np.std([2, 6], ddof=1) / np.sqrt(2))
    with pytest.raises(ValueError, match="Missing required"):
        windows_to_x(spark.createDataFrame(rows, cols).drop("l2"))


def test_fallback_levels(spark):
    x, _, _ = make_table()
    df = spark.createDataFrame(x)
    fit = fit_normalization(df.filter("subdir = 'deep' AND x <> 'only3'"))
    got = {(r["subdir"], r["x"]): r["l2_normalization_level"] for r in apply_normalization(df, fit).collect()}
    assert got[("deep", "0")] == "subdir_x" and got[("deep", "only3")] == "subdir_fallback" and got[("wide", "0")] == "global_fallback"


def test_clean_and_violations(spark):
    x, _, _ = make_table()
    df = spark.createDataFrame(x)
    assert Q.clean_x_metrics(df).schema["n_windows"].dataType.simpleString() == "bigint"
    bad = df.unionByName(df.limit(1))
    with pytest.raises(ValueError, match="duplicate_key"):
        Q.clean_x_metrics(bad)
    with pytest.raises(ValueError, match="Missing required"):
        Q.clean_x_metrics(df.drop("kl_var"))
    with pytest.raises(ValueError, match="no rows"):
        Q.clean_x_metrics(df.limit(0))


def test_directions():
    assert metric_direction("l2_similarity") == -1 and metric_direction("pesq") == 1 and metric_direction("anything") == 1
    assert metric_direction("pesq", {"pesq": -3}) == -1 and metric_direction("kl", {"kl": "HIGHER"}) == 1
    with pytest.raises(ValueError):
        metric_direction("kl", {"kl": "sideways"})


def test_solvers_against_enumeration():
    rng = np.random.default_rng(10)
    a = rng.normal(size=(20, 9, 5))
    g = np.einsum("nri,nrj->nij", a, a) + 0.5 * np.eye(5)
    c = rng.normal(size=(20, 5)) * 4
    b = solve_nonneg(g, c)
    slope = c - np.einsum("nij,nj->ni", g, b)
    assert (b >= 0).all() and (slope <= 1e-9).all() and np.abs(slope * b).max() < 1e-9
    e = solve_elastic(g, c, np.full(20, 0.7), np.full(20, 0.2))
    s = c - np.einsum("nij,nj->ni", g, e) - 0.2 * e
    assert np.all(np.where(e != 0, np.abs(s - 0.7 * np.sign(e)) < 1e-8, np.abs(s) <= 0.7 + 1e-8))
