"""Sample and frame series, and batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as A
from checks.registry import check, r, tidy
from hearken.operators import series as S


@check("d30_level_stats", f"""WITH {A.SAMPLES}, lv AS (SELECT series, count(*) AS n, 20.0 * log10(sqrt(avg(value * value) + 1e-12)) AS db, max(abs(value)) AS pk FROM samples GROUP BY 1)
    SELECT series, n AS n_samples, {r('db')} AS rms_dbfs, {r('pk')} AS peak, {r('pow(10.0, (-23.0 - db) / 20.0)')} AS gain,
    {r('CASE WHEN pk * pow(10.0, (-23.0 - db) / 20.0) > 0.99 THEN 0.99 / pk ELSE pow(10.0, (-23.0 - db) / 20.0) END')} AS limited_gain FROM lv""")
def d30(spark, sf):
    return tidy(S.level_stats(A.samples(spark, sf), ["series"]))


@check("d30_normalize_level", f"""WITH {A.SAMPLES}, lv AS (SELECT series, 20.0 * log10(sqrt(avg(value * value) + 1e-12)) AS db, max(abs(value)) AS pk FROM samples GROUP BY 1)
    SELECT s.series, i, {r('value * CASE WHEN pk * pow(10.0, (-3.0 - db) / 20.0) > 0.99 THEN 0.99 / pk ELSE pow(10.0, (-3.0 - db) / 20.0) END')} AS value
    FROM samples s JOIN lv ON lv.series = s.series""")
def d30n(spark, sf):
    return tidy(S.normalize_level(A.samples(spark, sf), ["series"], target=-3.0))


@check("e6_frame_rms", f"""WITH {A.SAMPLES}, ln AS (SELECT series, max(i) + 1 AS len FROM samples GROUP BY 1),
    fr AS (SELECT series, len, unnest(range(0, CAST(1 + ceil(greatest(len - 48, 0) / 20.0) AS BIGINT))) AS frame FROM ln),
    e AS (SELECT f.series, f.frame, coalesce(sum(value * value), 0) AS e FROM fr f LEFT JOIN samples s ON s.series = f.series AND s.i >= f.frame * 20 AND s.i < f.frame * 20 + 48 GROUP BY 1, 2)
    SELECT series, frame, {r('sqrt(e / 48.0 + 1e-12)')} AS rms, {r('20.0 * log10(sqrt(e / 48.0 + 1e-12) + 1e-12)')} AS db FROM e""")
def e6(spark, sf):
    return tidy(S.frame_rms(A.samples(spark, sf), ["series"], 48, 20))


def segments_sql(threshold, gap, min_len, pad, drop_first=False):
    keep = "WHERE k > 0" if drop_first else ""
    shift = " - 1" if drop_first else ""
    return f"""WITH {A.FRAMES}, sp AS (SELECT recording_id, max(frame) + 1 AS fin FROM frames GROUP BY 1),
    act AS (SELECT recording_id, frame, frame - (lag(frame) OVER w + 1) AS g FROM frames WHERE db > {threshold} WINDOW w AS (PARTITION BY recording_id ORDER BY frame)),
    rn AS (SELECT *, sum(CASE WHEN g IS NULL OR g > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY frame) AS run FROM act),
    sg AS (SELECT recording_id, run, greatest(0.0, min(frame) - {pad}) AS s, least(CAST(max(fin) AS DOUBLE), max(frame) + 1 + {pad}) AS e
        FROM rn JOIN sp USING (recording_id) GROUP BY 1, 2),
    nb AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY s, e) - 1 AS k FROM sg WHERE e - s >= {min_len})
    SELECT recording_id, k{shift} AS segment, {r('s')} AS segment_start, {r('e')} AS segment_end, {r('e - s')} AS duration FROM nb {keep}"""


@check("e5_silence_segments", segments_sql(36.0, 2, 3.0, 0.5))
def e5(spark, sf):
    """Small chunks, so that runs are stitched across chunk borders."""
    return tidy(S.silence_segments(A.frames(spark, sf), ["recording_id"], 36.0, 1.0, 2, 3.0, 0.5, chunk=7))


@check("e5_drop_first_segment", segments_sql(38.0, 1, 1.0, 0.0, True))
def e5d(spark, sf):
    return tidy(S.silence_segments(A.frames(spark, sf), ["recording_id"], 38.0, 1.0, 1, 1.0, 0.0, drop_first=True))


LAG = f"""{A.SAMPLES}, z AS (SELECT series, i, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8) AS v FROM samples WINDOW w AS (PARTITION BY series)),
    sh AS (SELECT * FROM (SELECT series - 1 AS series, i, v FROM z) t),
    lg AS (SELECT unnest(range(-12, 13)) AS lag), co AS (SELECT a.series, lg.lag, sum(a.v * b.v) AS c FROM z a, lg, sh b WHERE b.series = a.series AND b.i = a.i + lg.lag GROUP BY 1, 2)"""


def _neighbour_series(spark, sf):
    s = A.samples(spark, sf)
    return s, s.withColumn("series", F.col("series") - 1)


@check("c13_cross_correlation", f"WITH {LAG} SELECT series, lag, {r('c')} AS correlation FROM co")
def c13(spark, sf):
    ref, test = _neighbour_series(spark, sf)
    return tidy(S.correlations(ref, test, ["series"], 12))


@check("c13_f7_estimate_lag", f"WITH {LAG} SELECT series, lag, {r('c')} AS correlation, lag * 3 AS lag_samples FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY c DESC, lag) AS k FROM co) WHERE k = 1")
def f7(spark, sf):
    ref, test = _neighbour_series(spark, sf)
    return tidy(S.estimate_lag(ref, test, ["series"], 12, scale=3.0))


@check("c13_align_by_lag", f"""WITH {LAG}, best AS (SELECT series, lag FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY c DESC, lag) AS k FROM co) WHERE k = 1),
    raw AS (SELECT * FROM (SELECT series - 1 AS series, i, value FROM samples) t)
    SELECT a.series, count(*) AS n, CAST(min(a.i - greatest(0, -lag)) AS BIGINT) AS first_i, {r('sum(a.value * b.value)')} AS dot FROM samples a JOIN best ON best.series = a.series
    JOIN raw b ON b.series = a.series AND b.i = a.i + lag GROUP BY 1""")
def c13a(spark, sf):
    ref, test = _neighbour_series(spark, sf)
    lags = S.estimate_lag(ref, test, ["series"], 12)
    al = S.align_by_lag(ref, test, lags, ["series"])
    return tidy(al.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first_i"), F.sum(F.col("ref_value") * F.col("test_value")).alias("dot")))


@check("c13_check_overlap", f"""WITH {LAG}, best AS (SELECT series, lag FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY c DESC, lag) AS k FROM co) WHERE k = 1),
    ln AS (SELECT series, max(i) + 1 AS n FROM samples GROUP BY 1)
    SELECT best.series, lag AS lag_samples, least(a.n - greatest(-lag, 0), b.n - greatest(lag, 0)) AS overlap FROM best JOIN ln a ON a.series = best.series JOIN ln b ON b.series = best.series + 1""")
def c13o(spark, sf):
    ref, test = _neighbour_series(spark, sf)
    return tidy(S.check_overlap(ref, test, S.estimate_lag(ref, test, ["series"], 12), ["series"]))


# --- streams: batch twins ------------------------------------------------------
@check("i1_sliding_windows", f"""WITH w AS (SELECT user_id, event_type, value, epoch_us(ts) AS us FROM events),
    x AS (SELECT user_id, event_type, value, unnest(range(CAST(floor(us / 86400000000.0) AS BIGINT) - 4, CAST(floor(us / 86400000000.0) AS BIGINT) + 1)) AS d FROM w)
    SELECT user_id AS name, event_type AS subdir, d * 86400000000 AS window_start, count(*) AS n_windows, {r('avg(value)')} AS value_mean, {r('coalesce(var_samp(value), 0)')} AS value_var
    FROM x GROUP BY 1, 2, 3""")
def i1(spark, sf):
    from hearken.streaming.windows import sliding_metrics

    e = A.load(spark, sf, "events").select(F.col("user_id").alias("name"), F.col("event_type").alias("subdir"), F.col("ts").cast("timestamp").alias("ts"), "value")
    out = sliding_metrics(e, ["name", "subdir"], ["value"], "ts", "5 days", "1 day")
    return tidy(out.withColumn("window_start", F.unix_micros("window_start")))


@check("i3_session_segments", f"""WITH o AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 21600000000 THEN 1 ELSE 0 END AS b
    FROM events WHERE value > 20 WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o)
    SELECT user_id AS recording_id, epoch_us(min(ts)) AS segment_start, count(*) AS n_active, {r('(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6')} AS active_seconds FROM g GROUP BY user_id, s""")
def i3(spark, sf):
    from hearken.streaming.silence import session_segments

    e = A.load(spark, sf, "events").select(F.col("user_id").alias("recording_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    out = session_segments(e, ["recording_id"], "ts", "value", 20.0, "6 hours")
    return tidy(out.withColumn("segment_start", F.unix_micros("segment_start")))
