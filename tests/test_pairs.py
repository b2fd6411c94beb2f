"""Pairs of blocks: copies are bounded, every pair is met once, large groups are fitted on blocks written once."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearken.operators import evaluation as E
from hearken.operators import skew
from hearken.plans import softrank


def test_small_blocks_do_not_multiply_copies(spark):
    n = 4_000
    rows = spark.range(n).select(F.lit(None).cast("string").alias("g"), "id")
    sized = rows.withColumn("__nb", skew.pair_blocks(F.lit(n), 32)).withColumn("__b", F.pmod(F.xxhash64("id"), F.col("__nb")).cast("int"))
    met = skew.block_pairs(sized.groupBy("g", "__nb", "__b").agg(F.collect_list("id").alias("v")), ["g"], ["v"])
    out = met.agg(F.sum(F.size("v_lo") + F.size("v_hi")), F.count(F.lit(1))).first()
    assert out[0] <= n * (skew.BLOCKS + 1) and out[1] == skew.BLOCKS * (skew.BLOCKS + 1) // 2
    assert met.filter("__lo < __hi").agg(F.sum(F.size("v_lo").cast("long") * F.size("v_hi"))).first()[0] + sized.groupBy("__b").count().agg(
        F.sum(F.expr("count * (count - 1) DIV 2"))).first()[0] == n * (n - 1) // 2


def test_tiles_cover_a_block_once():
    for same, a, b in ((True, 7, 7), (False, 7, 4)):
        seen = np.zeros((a, b), dtype=int)
        for p, q, mask in skew.tile_pairs(a, b, same, 3):
            seen[p, q] += mask
        assert (seen == (np.triu(np.ones((a, b), dtype=int), 1) if same else 1)).all()


def test_pair_metrics_of_many_small_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(g, f"{g}{i}", float(t), float(p)) for g, n in (("a", 1_300), (None, 40)) for i, (t, p) in enumerate(zip(np.round(rng.normal(0, 3, n), 1), np.round(rng.normal(0, 3, n), 1)))]
    got = E.tie_pair_metrics(spark.createDataFrame(rows, "g string, k string, t double, p double"), "k", "t", "p", "g", block_rows=8).first()
    far = near = right = 0
    for group in ("a", None):
        t, p = (np.array([r[c] for r in rows if r[0] == group]) for c in (2, 3))
        i, j = np.triu_indices(len(t), 1)
        dt, dp = t[i] - t[j], p[i] - p[j]
        far, near, right = far + (abs(dt) > 1).sum(), near + (abs(dt) <= 1).sum(), right + ((np.sign(dt) == np.sign(dp)) & (abs(dt) > 1)).sum()
    assert (got.num_ordered_pairs, got.num_tie_pairs) == (far, near)
    assert got.pairwise_accuracy_over_margin == pytest.approx(right / far)


def test_specs_of_a_large_group_share_their_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"d{i}", float(rng.normal(50, 9)) if i % 7 else None, float(rng.normal(60, 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "name string, q double, t double").withColumns({"w": F.lit(0.8), "one": F.lit(1)})
    specs = [(0, "", 0.1, 0.25), (1, "", 10.0, 4.0)]
    small = softrank.fit_groups(df, ["q"], "t", "w", specs, ["one"]).orderBy("spec_idx").collect()
    written = []
    keep = softrank.materialise
    monkeypatch.setattr(softrank, "materialise", lambda d: written.append("x_lo" in d.columns) or keep(d))
    monkeypatch.setattr(softrank, "GROUP_ROWS", 10)
    large = softrank.fit_groups(df, ["q"], "t", "w", specs, ["one"]).orderBy("spec_idx").collect()
    assert sum(written) == 1
    for a, b in zip(small, large):
        assert b.beta == pytest.approx(a.beta, abs=1e-5) and b.optimality < 1e-6
