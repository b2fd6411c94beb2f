"""Numbering over ranges and pair counts by merging, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearken.operators.dominance import merge_count, ordered_alike, tied_pairs
from hearken.operators.evaluation import rank_pairs
from hearken.operators.numbering import numbered


def test_numbers_run_through_each_group(spark):
    rows = [(g, i * 7919 % 1000) for g, n in (("a", 700), ("b", 1), ("c", 300), (None, 5)) for i in range(n)]
    frame = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = numbered(frame, ["g"], ["v"], "pos").collect()
    for g in ("a", "b", "c", None):
        own = sorted((r.pos, r.v) for r in got if r.g == g)
        assert [p for p, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
    assert sorted(r.pos for r in numbered(frame, [], [F.col("v").desc(), "g"], "pos").collect()) == list(range(len(rows)))
    assert numbered(frame.limit(0), ["g"], ["v"], "pos").count() == 0


def test_merge_count_equals_all_pairs():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 200):
        first, second = rng.integers(0, max(2, n // 2), n), rng.permutation(n)
        w, q = rng.integers(0, 3, n), rng.integers(0, 3, n)
        want = sum(int(q[i]) * int(w[j]) for i in range(n) for j in range(n) if first[j] < first[i] and second[j] < second[i])
        assert merge_count(first, second, w, q) == want
    n = 200_000
    assert merge_count(np.arange(n), np.arange(n), np.ones(n), np.ones(n)) == n * (n - 1) // 2
    assert merge_count(np.arange(n), np.arange(n)[::-1], np.ones(n), np.ones(n)) == 0


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("gap, strict", [(0.0, True), (2.0, True), (2.0, False)])
def test_pairs_ordered_alike(spark, bounded, gap, strict):
    rng = np.random.default_rng(3)
    rows = [(g, float(rng.integers(0, 12)), float(rng.integers(0, 9)) - 4.0) for g, n in (("a", 150), ("b", 40), ("c", 1)) for _ in range(n)]
    frame = spark.createDataFrame(rows, "g string, t double, p double")
    got = {r.g: r.alike for r in ordered_alike(frame, ["g"], "t", "p", gap, strict, bounded, bucket_rows=16).collect()}
    for g in "abc":
        own = [r[1:] for r in rows if r[0] == g]
        want = sum((a[0] - b[0] > gap if strict else a[0] - b[0] >= gap) and a[1] > b[1] for a in own for b in own)
        assert got[g] == want


def test_rank_pairs_and_ties(spark):
    rng = np.random.default_rng(4)
    t, p = rng.integers(0, 20, 300).astype(float), rng.normal(size=300).round(1)
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, p)], "t double, p double")
    r = rank_pairs(frame, [], "t", "p", 3.0).first()
    i, j = np.triu_indices(300, 1)
    dt, dp = t[i] - t[j], p[i] - p[j]
    assert (r.pairs, r.concordant, r.discordant) == (len(i), (dt * dp > 0).sum(), (dt * dp < 0).sum())
    assert (r.ties_true, r.ties_pred) == ((dt == 0).sum(), (dp == 0).sum())
    assert (r.far, r.far_correct) == ((abs(dt) > 3).sum(), ((abs(dt) > 3) & (dt * dp > 0)).sum())
    assert tied_pairs(frame, [], ["t", "p"], "n").first().n == ((dt == 0) & (dp == 0)).sum()


def test_a_million_rows_of_one_group(spark):
    n = 1_000_000
    frame = spark.range(n).select(F.col("id").cast("double").alias("t"), ((F.col("id") * 7919) % n).cast("double").alias("p"))
    got = ordered_alike(frame, [], "t", "p").first().alike
    t = np.arange(n)
    assert got == merge_count(t, (t * 7919) % n, np.ones(n), np.ones(n))


def test_folds_of_ids_with_one_prefix_are_spread(spark):
    from hearken.operators.folds import assign_folds

    n = 400_000
    frame = spark.range(n).select(F.format_string("device-of-one-maker-%09d", "id").alias("name"))
    folds = assign_folds(frame, "name", "leave_one_out")
    assert folds.agg(F.countDistinct("fold").alias("n"), F.min("fold").alias("a"), F.max("fold").alias("b")).first() == (n, 0, n - 1)
    laid = frame.repartitionByRange(8, "name").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert laid.max() <= 2 * laid.median()


@pytest.mark.parametrize("inclusive", [True, False])
def test_similar_devices_where_scores_lie_dense(spark, inclusive, monkeypatch):
    from hearken.operators import ranking

    monkeypatch.setattr(ranking, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(8)
    scores = np.concatenate([rng.normal(50, 0.5, 150).round(1), rng.uniform(0, 100, 40).round(1), [48.0] * 30])
    known = [("g" if k % 3 else "h", f"k{k}", float(s)) for k, s in enumerate(scores)]
    pred = [("g", f"k{k}", float(scores[k])) for k in range(1, 40, 3)] + [("g", "new", 50.0), ("h", "far", 500.0), ("h", "low", -5.0), ("none", "x", 50.0)]
    got = ranking.similar_devices(spark.createDataFrame(pred, "g string, name string, prediction double"), spark.createDataFrame(known, "g string, known string, score double"), ["g"], 2.0, inclusive)
    want = {(g, n, k) for g, n, p in pred for h, k, s in known if g == h and k != n and (abs(p - s) < 2.0 if inclusive else abs(p - s) <= 2.0)}
    rows = [(r.g, r.name, r.known) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
