"""Lags by Fourier blocks and silence over chunks against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearken.operators import series as S


@pytest.mark.parametrize("block", [None, 16, 50])
def test_correlations_equal_plain_sums(spark, block):
    rng = np.random.default_rng(3)
    ref = [("a", i, float(rng.normal())) for i in range(200)] + [("b", int(i), float(rng.normal())) for i in sorted(rng.choice(5000, 60, replace=False))] + [("c", 0, 1.0)]
    test = [("a", i, float(rng.normal())) for i in range(-5, 230)] + [("b", int(i), float(rng.normal())) for i in sorted(rng.choice(5000, 80, replace=False))] + [("c", 900, 1.0), ("d", 1, 1.0)]
    frame = lambda rows: spark.createDataFrame(rows, "s string, i long, value double")
    got = {(r.s, r.lag): r.correlation for r in S.correlations(frame(ref), frame(test), ["s"], 30, block=block).collect()}
    want = {}
    for s in "abc":
        z = []
        for rows in (ref, test):
            own = {i: v for k, i, v in rows if k == s}
            mean, sd = np.mean(list(own.values())), np.std(list(own.values())) + 1e-8
            z.append({i: (v - mean) / sd for i, v in own.items()})
        for i, v in z[0].items():
            for lag in range(-30, 31):
                if i + lag in z[1]:
                    want[s, lag] = want.get((s, lag), 0.0) + v * z[1][i + lag]
    assert set(got) == set(want)
    assert max(abs(got[k] - w) for k, w in want.items()) < 1e-9


def test_ten_seconds_at_eight_kilohertz(spark):
    """The default range on one long pair: the test series is the reference 23,456 samples later."""
    n, lag = 400_000, 23_456
    ref = spark.range(n).select(F.lit(1).alias("s"), F.col("id").alias("i"), F.sin(F.col("id") * F.col("id") % 977).alias("value"))
    test = ref.withColumn("i", F.col("i") + lag)
    assert S.correlations(ref, test, ["s"], 80_000).count() == 160_001
    best = S.estimate_lag(ref, test, ["s"], 80_000).first()
    assert best.lag == lag and best.correlation == pytest.approx(n, rel=1e-6)


def test_silence_of_a_long_recording_over_many_chunks(spark):
    rng = np.random.default_rng(4)
    db = np.where(rng.random(20_000) < 0.55, -20.0, -80.0)
    db[5_000:9_000] = -20.0  # one run over many chunks
    frame = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(db)] + [("q", 3, -10.0)], "rec string, frame long, db double")
    runs, start = [], None
    active = np.flatnonzero(db > -40.0)
    for i in active:
        if start is None or i - stop > 2:
            if start is not None:
                runs.append((start, stop))
            start = i
        stop = i + 1
    runs.append((start, stop))
    want = [(max(0.0, a * 0.5 - 0.2), min(len(db) * 0.5, b * 0.5 + 0.2)) for a, b in runs]
    want = [w for w in want if w[1] - w[0] >= 1.5]
    for chunk in (64, 65_536):
        got = S.silence_segments(frame, ["rec"], -40.0, 0.5, 2, 1.5, 0.2, chunk=chunk).filter("rec = 'r'").orderBy("segment").collect()
        assert [r.segment for r in got] == list(range(len(want)))
        assert [(r.segment_start, r.segment_end) for r in got] == [pytest.approx(w) for w in want]


def test_correlations_keep_nothing_of_a_batch():
    """Thousands of short series in one batch: no product of full block length is made or kept."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    cells = [[{"i": int(i), "v": float(rng.normal())} for i in range(40)] for _ in range(2_000)]
    shape = pa.list_(pa.struct([("i", pa.int32()), ("v", pa.float64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2_000)), pa.array(cells, shape), pa.array(cells, shape)], names=["s", "__r", "__t"])
    tracemalloc.start()
    rows = 0
    for out in S._correlate(["s"], 12)(iter([batch])):
        rows += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2_000 * 25 and peak < 200e6
