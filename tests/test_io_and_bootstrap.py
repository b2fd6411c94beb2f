"""Readers, writers, splits, bootstrap, window-level job and fusion."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import make_table
from hearken.operators.folds import assign_folds, split_one_per_group
from hearken.operators.linear import fit_ridge
from hearken.plans import bootstrap as B
from hearken.plans import fusion, scoring, softrank
from hearken.operators.normalize import expected_items, fit_normalization
from hearken.sources import labels as L
from hearken.sources import sinks as W
from hearken.sources import tables as T
from hearken.sources.tokens import first_codebook, token_table


def test_column_map(spark, tmp_path):
    x, _, _ = make_table()
    path = str(tmp_path / "x.csv")
    x.rename(columns={"name": "设备", "l2_mean": "L2"}).to_csv(path, index=False)
    spec = tmp_path / "map.json"
    spec.write_text(json.dumps({"name": "设备", "l2_mean": "L2"}), encoding="utf-8")
    got = T.read_x_metrics(spark, path, str(spec))
    assert {"name", "l2_mean"} <= set(got.columns) and got.count() == len(x)
    for bad, text in (({"nope": "a"}, "not a canonical"), ({"name": "a", "x": "a"}, "one input"), ({"name": "subdir"}, "of one name")):
        with pytest.raises(ValueError, match=text):
            T.rename_columns(got, bad)


def test_labels(spark, tmp_path):
    doc = {"deep": {"a": 75, "b": {"score": 60.5}, "c": True, "d": "12", "e": {"mos": 3}, "f": {"other": 1}}, "junk": 4, "overall": {"a": 70, "b": None}}
    path = tmp_path / "s.json"
    path.write_text(json.dumps(doc))
    sub, ov = L.read_human_scores(spark, str(path))
    assert {(r["name"], r["human_score"]) for r in sub.collect()} == {("a", 75.0), ("b", 60.5), ("e", 3.0)}
    assert [tuple(r) for r in ov.collect()] == [("a", 70.0)]
    sub, _ = L.read_human_scores(spark, str(path), lenient=True)
    assert {r["name"] for r in sub.collect()} == {"a", "b", "d", "e"}
    flip = {"a": {"deep": 75, "overall": 70}}
    path.write_text(json.dumps(flip))
    sub, ov = L.read_human_scores(spark, str(path), "device_first")
    assert [tuple(r) for r in sub.collect()] == [("a", "deep", 75.0)] and ov.count() == 1


def test_token_shapes(spark):
    full = spark.createDataFrame([(1, "p", 0, [-0.1, -2.0])], "pair_key int, side string, step int, logprobs array<double>")
    assert [(r["token_id"], r["kind"]) for r in token_table(full).collect()] == [(0, "full"), (1, "full")]
    top = spark.createDataFrame([(1, "p", 0, [7, 9], [-0.1, -2.0])], "pair_key int, side string, step int, top_token_ids array<int>, top_logprobs array<double>")
    assert [r["token_id"] for r in token_table(top).collect()] == [7, 9]
    with pytest.raises(ValueError):
        token_table(full.drop("logprobs"))
    t = spark.createDataFrame([([1, 2, 3, 4, 5, 6, 7, 8],), ([1, 2, 3],)], "tokens array<int>")
    assert [r["tokens"] for r in first_codebook(t).collect()] == [[1, 5], [1, 2, 3]]


def test_sinks_and_empty_results(spark, tmp_path):
    a = spark.createDataFrame([(1, float("nan"))], "k int, v double")
    b = spark.createDataFrame([(2, "x")], "k int, t string")
    assert W.union_rows(a, b).columns == ["k", "v", "t"]
    assert W.to_json_rows(a).first()[0] == '{"k":1,"v":null}'
    W.write_tables({"a": a.limit(0)}, str(tmp_path / "o"))
    back = spark.read.parquet(str(tmp_path / "o" / "a"))
    assert back.columns == ["k", "v"] and back.count() == 0
    W.write_json_document(str(tmp_path / "m"), {"n": 1}, a)
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"n": 1}


def test_pairs_and_todo(spark, tmp_path):
    for d, names in (("r", ["a.wav", "b.wav", "n.txt"]), ("t", ["b.wav", "a.wav", "c.wav"])):
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_bytes(b"0")
    got = T.pair_by_stem(T.paths_under(spark, str(tmp_path / "r")), T.paths_under(spark, str(tmp_path / "t"))).collect()
    assert [r["key"] for r in got] == ["a", "b"] and got[0]["ref_path"].endswith("/r/a.wav")


def test_folds_and_split(spark):
    df = spark.createDataFrame([(f"n{i % 7}", i) for i in range(40)], "name string, i int")
    f = assign_folds(df, "i", "kfold", 5, 1).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in f) == [8] * 5
    g = assign_folds(df, "name", "group", 3)
    assert g.groupBy("name").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty() and g.select("fold").distinct().count() == 3
    assert assign_folds(df.filter("i < 3"), "i", "kfold", 5).filter("fold IS NOT NULL").isEmpty()
    assert assign_folds(df.filter("name < 'n2'"), "name", "group", 5).filter("fold IS NOT NULL").isEmpty()
    s = split_one_per_group(df, ["name"], "i", 4)
    assert s.filter("is_train").count() == 7 and s.filter("is_train").select("name").distinct().count() == 7
    again = split_one_per_group(df.repartition(3), ["name"], "i", 4)
    assert s.filter("is_train").exceptAll(again.filter("is_train")).isEmpty()
    assert not s.filter("is_train").exceptAll(split_one_per_group(df, ["name"], "i", 5).filter("is_train")).isEmpty()


def small_model(spark, x, ov):
    fit = spark.createDataFrame(x)
    p = ([0.0] * 4, [0.0] * 4, [1.0] * 4, [5.0, 1.0, 4.0, 1.0])
    rows = [(s, "primary", 1.0, 0.0, *p, 50.0) for s in ("deep", "wide")]
    cols = "subdir string, variant string, alpha double, gamma double, median array<double>, mean array<double>, scale array<double>, coef array<double>, intercept double"
    overall = [([50.0, 50.0], [50.0, 50.0], [10.0, 10.0], [70.0, 5.0, 4.0, -1.0, -2.0])]
    return scoring.Model(
        ["deep", "wide"], fit_normalization(fit), expected_items(fit), spark.createDataFrame(rows, cols),
        spark.createDataFrame([], "subdir string, median array<double>, mean array<double>, scale array<double>, coef array<double>, intercept double"),
        spark.createDataFrame(overall, "median array<double>, mean array<double>, scale array<double>, beta array<double>"), spark.createDataFrame(ov))


def test_bootstrap(spark):
    x, _, ov = make_table()
    model = small_model(spark, x, ov)
    new = spark.createDataFrame(x[x.name.isin(["d2", "d4"])])
    with pytest.raises(ValueError, match="20"):
        B.resample(new, 5)
    out = B.predict_with_intervals(model, new, 60, 1)
    r = {row["name"]: row for row in out["ranking"].collect()}
    assert r["d2"]["bootstrap_mode"] == "contains_within_only_limited_subdirs" and r["d2"]["limited_ci_subdirs"] == "wide"
    assert "bootstrap_ci_limited_for_single_x" in r["d2"]["reliability_warning"] and r["d4"]["limited_ci_subdirs"] == ""
    for row in r.values():
        assert row["bootstrap_replicates"] == 60 and row["overall_ci_low"] <= row["overall_ci_high"] and row["possible_rank_low"] <= row["possible_rank_high"]
    again = B.bootstrap_replicates(model, new.repartition(5), 60, 1)["overall_replicates"]
    diff = out["overall_replicates"].alias("a").join(again.alias("b"), ["replicate", "name"]).filter("abs(a.overall_prediction - b.overall_prediction) > 1e-9")
    assert diff.isEmpty()
    draw = B.seeded(4)
    picks, z = zip(*(draw("d", "s", 50, r) for r in range(400)))
    z = np.concatenate([v.reshape(-1) for v in z])
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and np.bincount(np.concatenate(picks), minlength=50).min() > 300


def test_replicates_equal_the_pipeline_on_resampled_rows(spark):
    """Every replicate is what plain scoring gives for its rows."""
    x, _, ov = make_table()
    model = small_model(spark, x, ov)
    new = spark.createDataFrame(x[x.name.isin(["d2", "d4", "d5"])])
    got = {(r.replicate, r.name): r.overall_prediction for r in B.bootstrap_replicates(model, new, 70, 9)["overall_replicates"].collect()}
    rows = B.resample(new, 70, 9).toPandas()
    assert len(got) == 210
    for replicate in (0, 63, 64, 69):
        own = spark.createDataFrame(rows[rows.replicate == replicate].drop(columns="replicate"))
        for r in scoring.score_devices(model, own)["overall"].collect():
            assert got[replicate, r["name"]] == pytest.approx(r["overall_prediction"], abs=1e-9)


def test_prediction_with_missing_subdir(spark):
    x, _, ov = make_table()
    model = small_model(spark, x, ov)
    rows = x[(x.name == "d4") & (x.subdir == "deep")].assign(name="half")
    other = x[(x.name == "d4")].assign(name="alien", subdir="unheard")
    out = scoring.predict(model, spark.createDataFrame(rows).unionByName(spark.createDataFrame(other)))
    r = {row["name"]: row for row in out["ranking"].collect()}
    assert r["half"]["subdir_coverage"] == 0.5 and r["half"]["reliability_warning"].startswith("missing_subdirs=wide")
    assert r["alien"]["subdir_coverage"] == 0.0 and r["alien"]["overall_prediction"] == pytest.approx(67.0) and r["alien"]["overall_reliability"] == pytest.approx(0.1)
    assert out["pairwise_probabilities"].count() == 14


def test_soft_rank_is_a_minimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(50, 10, (15, 3))
    x[2, 0] = x[5, 1] = np.nan
    t = 40 + 0.4 * np.nan_to_num(x[:, 0], nan=50) + rng.normal(0, 3, 15)
    w = rng.uniform(0.3, 1, 15)
    df = spark.createDataFrame([("g", f"n{i}", *[None if np.isnan(v) else float(v) for v in x[i]], float(t[i]), float(w[i])) for i in range(15)], "g string, name string, a double, b double, c double, t double, w double")
    fit = softrank.fit_groups(df, ["a", "b", "c"], "t", "w", [(0, "k", 1.0, 4.0)], ["g"]).first()
    design, _ = softrank.design(x)
    f = softrank.objective(design, t, w, 1.0, 4.0)
    beta = np.array(fit["beta"])
    best = f(beta)[0]
    assert fit["optimality"] < 1e-8 and (beta[1:4] >= 0).all()
    for _ in range(300):
        trial = beta + rng.normal(0, 0.05, 7)
        trial[1:4] = np.maximum(trial[1:4], 0)
        assert f(trial)[0] >= best - 1e-12
    eps = 1e-6
    point = np.abs(rng.normal(1, 1, 7))
    num = [(f(point + eps * e)[0] - f(point - eps * e)[0]) / (2 * eps) for e in np.eye(7)]
    assert np.allclose(num, f(point)[1], rtol=1e-4, atol=1e-6)
    small = df.unionByName(df.filter("name < 'n13'").withColumn("g", F.lit("h"))).unionByName(df.filter("name < 'n12'").withColumn("g", F.lit(None).cast("string")))
    here = {r["g"]: r for r in softrank.fit_groups(small, ["a", "b", "c"], "t", "w", [(0, "k", 1.0, 4.0)], ["g"]).collect()}
    softrank.GROUP_ROWS, old = 3, softrank.GROUP_ROWS
    try:
        spread = {r["g"]: r for r in softrank.fit_groups(small, ["a", "b", "c"], "t", "w", [(0, "k", 1.0, 4.0)], ["g"]).collect()}
    finally:
        softrank.GROUP_ROWS = old
    assert set(here) == set(spread) == {"g", "h", None}
    for g in here:
        assert here[g]["n"] == spread[g]["n"] and np.allclose(here[g]["beta"], spread[g]["beta"], atol=1e-5) and spread[g]["optimality"] < 1e-6


def test_ridge_and_fusion_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 60
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = x @ [2.0, -0.3, 4.0] + rng.normal(0, 1, n)
    df = spark.createDataFrame([(f"r{i}", *map(float, x[i]), float(y[i])) for i in range(n)], "key string, a double, kl double, c double, mos double")
    z = (x - x.mean(0)) / x.std(0)
    fit = fit_ridge(df, ["a", "kl", "c"], "mos", [2.0], nonneg=False).first()
    want = np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(fit["coef"], want) and fit["intercept"] == pytest.approx(y.mean())
    res = fusion.fit_fusion(df, "mos", "ridge", ["a", "kl", "c"])
    d = z * [1, -1, 1]
    errs = []
    for a in fusion.RIDGE_ALPHAS:
        loo = []
        for i in range(n):
            m = np.arange(n) != i
            c = d[m] - d[m].mean(0)
            b = np.linalg.solve(c.T @ c + a * np.eye(3), c.T @ (y[m] - y[m].mean()))
            loo.append(y[i] - y[m].mean() - (d[i] - d[m].mean(0)) @ b)
        errs.append(np.mean(np.square(loo)))
    assert res["model"].first()["alpha"] == pytest.approx(fusion.RIDGE_ALPHAS[int(np.argmin(errs))])
    assert res["directions"]["kl"] == "lower_is_better" and {r["scope"] for r in res["summary"].collect()} == {"train_fit", "cross_validation"}
    assert res["predictions"].filter("predicted_score_cv IS NULL").isEmpty()
    few = fusion.fit_fusion(df.limit(3), "mos", "nnls", ["a"])
    assert "predicted_score_cv" not in few["predictions"].columns
    enet = fusion.fit_fusion(df, "mos", "elasticnet", ["a", "kl", "c"], cv_splits=1)
    assert enet["summary"].first()["rmse"] < 1.5


def test_a_bundle_is_seen_whole_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "bundle")
    one = spark.range(3).toDF("a")
    W.publish({"t": one, "u": one.filter("a < 0")}, {"d.json": {"k": "é"}}, out)

    def fails(folder):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        W.publish({"t": spark.range(9).toDF("a")}, {}, out, also=fails)
    tables, documents = W.read_published(spark, out)
    assert tables["t"].count() == 3 and tables["u"].columns == ["a"] and documents == {"d.json": {"k": "é"}}
    W.publish({"t": spark.range(9).toDF("a")}, {}, out, "csv")
    tables, documents = W.read_published(spark, out)
    assert set(tables) == {"t"} and tables["t"].count() == 9 and documents == {}
    with pytest.raises(ValueError, match="at least one"):
        W.publish({}, {}, out)


def test_pairs_of_mixed_kinds_are_refused(spark):
    from hearken.operators import divergence as D

    rows = [(1, 0, s, t, -1.0, k) for s, k in (("p", "full"), ("q", "topk")) for t in range(3)]
    frame = spark.createDataFrame(rows, "pair_key int, step int, side string, token_id int, logprob double, kind string")
    for how in (D.divergence, D.divergence_topk):
        with pytest.raises(ValueError, match="pair 1"):
            how(frame)
        assert how(frame.drop("kind")).count() == 1


def test_elastic_net_paths_meet_their_conditions(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    y = x @ [2.0, 0.0, -1.0] + rng.normal(size=300)
    frame = spark.createDataFrame([(f"r{i}", *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "key string, a double, b double, c double, mos double")
    res = fusion.fit_fusion(frame, "mos", "elasticnet", ["a", "b", "c"])
    row = fusion.elastic_optimality(res["model"]).first()
    assert row["violation"] < 1e-8 and len(row["inner_errors"]) == 100
    assert row["coef"][0] > 1.5 and row["coef"][2] < -0.5 and abs(row["coef"][1]) < 0.3
    assert res["summary"].count() == 2


def test_temporary_tables_go_at_the_end_of_their_scope(spark):
    import os

    from hearken.session import materialise, temporary_tables

    kept = materialise(spark.range(3))
    with temporary_tables(spark) as made:
        assert materialise(spark.range(5)).count() == 5
        path = made[0].removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.exists(path) and kept.count() == 3
