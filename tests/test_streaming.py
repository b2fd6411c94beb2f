"""Streams give what their batch twins give; the session follows its truth table."""

import pytest
from pyspark.sql import functions as F

from hearken.plans.domains import session_state
from hearken.streaming.sessions import DomainSession
from hearken.streaming.silence import session_segments
from hearken.streaming.windows import sliding_metrics


def by_day(spark, sf, path):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("name"), F.col("ts").cast("timestamp").alias("ts"), "value")
    e.withColumn("day", F.dayofmonth("ts")).repartition(1, "day").sortWithinPartitions("ts").write.partitionBy("day").parquet(path)
    return e


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_sliding_windows_stream(spark, sf, tmp_path):
    e = by_day(spark, sf, str(tmp_path / "in"))
    stream = spark.readStream.schema("name long, ts timestamp, value double").option("maxFilesPerTrigger", 40).parquet(str(tmp_path / "in"))
    run(sliding_metrics(stream, ["name"], ["value"], "ts", "2 days", "1 day", "40 days"), "sliding", "complete")
    a = spark.table("sliding").orderBy("name", "window_start").toPandas()
    b = sliding_metrics(e, ["name"], ["value"], "ts", "2 days", "1 day").orderBy("name", "window_start").toPandas()
    assert len(a) == len(b) and (a.n_windows == b.n_windows).all() and abs(a.value_mean - b.value_mean).max() < 1e-9


def test_append_mode_emits_closed_windows_only(spark, sf, tmp_path):
    e = by_day(spark, sf, str(tmp_path / "in"))
    stream = spark.readStream.schema("name long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    run(sliding_metrics(stream, ["name"], ["value"], "ts", "1 day", "1 day", "1 day"), "closed")
    got, full = spark.table("closed"), sliding_metrics(e, ["name"], ["value"], "ts", "1 day", "1 day")
    assert 0 < got.count() < full.count()
    assert got.select("name", "window_start", "n_windows").exceptAll(full.select("name", "window_start", "n_windows")).count() == 0


def test_session_segments_stream(spark, sf, tmp_path):
    e = by_day(spark, sf, str(tmp_path / "in"))
    stream = spark.readStream.schema("name long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    run(session_segments(stream, ["name"], "ts", "value", 20.0, "6 hours", "60 days"), "segments", "complete")
    a = spark.table("segments").select("name", "segment_start", "n_active")
    b = session_segments(e, ["name"], "ts", "value", 20.0, "6 hours").select("name", "segment_start", "n_active")
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


AUX = [("p1", "pc"), ("p2", "pc"), ("p3", "pc"), ("t1", "tablet"), ("t2", "tablet")]


@pytest.mark.parametrize("batches, domain, good, bad", [
    ([["p1"]], "pc", {"p1"}, set()),
    ([["t1", "t2"]], "tablet", {"t1", "t2"}, set()),
    ([["p1"], ["p2", "p1"]], "pc", {"p1", "p2"}, {"p1"}),
    ([["p1"], ["t1"]], "tablet", {"t1"}, set()),
    ([["t1"], ["p1", "zz"]], "pc", {"p1"}, {"zz"}),
    ([["p1"], ["p2", "t1"]], "pc", {"p1"}, set()),
    ([["p1"], ["xx", "yy"]], "pc", {"p1"}, {"xx", "yy"}),
    ([["xx"]], None, set(), {"xx"}),
    ([["xx"], ["t1"]], "tablet", {"t1"}, {"xx"}),
    ([["p1"], ["t1"], ["p2"]], "pc", {"p2"}, set()),
])
def test_domain_session(spark, tmp_path, batches, domain, good, bad):
    aux = spark.createDataFrame(AUX, "name string, domain string")
    session = DomainSession(spark, str(tmp_path / "state"), aux)
    for i, names in enumerate(batches):
        session.process(spark.createDataFrame([(n,) for n in names], "name string"), i)
    session.process(spark.createDataFrame([(n,) for n in batches[-1]], "name string"), len(batches) - 1)  # replay
    state = session.snapshot()
    rows = state.collect() if state is not None else []
    assert session.current_domain() == domain
    assert {r["name"] for r in rows if r["status"] == "success"} == good
    assert {r["name"] for r in rows if r["status"] == "failure"} == bad

    table = spark.createDataFrame([(i, n) for i, b in enumerate(batches) for n in b], "batch_id int, name string")
    g, f = session_state(table, aux)
    assert {r["name"] for r in g.collect()} == good and {r["name"] for r in f.collect()} == bad


def test_session_as_stream_and_replacement(spark, tmp_path):
    aux = spark.createDataFrame(AUX, "name string, domain string")
    for i, names in enumerate((["p1"], ["p2"], ["t2"])):
        spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={i}"))
    session = DomainSession(spark, str(tmp_path / "state"), aux)
    stream = spark.readStream.schema("name string").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in" / "b=0"))
    stream.writeStream.foreachBatch(session.process).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert session.current_domain() == "pc"
    with pytest.raises(ValueError, match="domain"):
        session.replace_auxiliary(spark.createDataFrame([("p1", "phone")], "name string, domain string"), 5)
    assert session.snapshot().count() == 1
    session.replace_auxiliary(aux, 6)
    assert session.snapshot().count() == 0 and session.current_domain() is None


def test_ranks_after_each_batch_equal_a_batch_twin_and_writes_are_linear(spark, tmp_path):
    import os

    from hearken.plans.domains import rank_domain

    aux = spark.createDataFrame([(f"p{i}", "pc") for i in range(40)] + [("t1", "tablet")], "name string, domain string")
    refs = spark.createDataFrame([("ref1", 3.0), ("ref2", 11.5)], "name string, rank_utility double")

    def scorer(rows):
        return rows.groupBy("name").agg(F.avg("value").alias("rank_utility"))

    session = DomainSession(spark, str(tmp_path / "state"), aux, scorer)
    batches = [[(f"p{i}", float(i * 7 % 13) + d) for i in range(a, a + 8) for d in (0.0, 1.0)] for a in (0, 8, 4, 16)] + [[("t1", 5.0), ("p1", 1.0)], [("t1", 5.0)]]
    seen: dict = {}
    for k, rows in enumerate(batches):
        session.process(spark.createDataFrame(rows, "name string, value double"), k)
        if k == 5:
            seen = {"t1": 5.0}
        elif k < 4:  # batch 4 is mixed
            fresh = {n: v for n, v in rows if n not in seen}
            seen |= {n: sum(v for m, v in rows if m == n) / 2 for n in fresh}
        domain = "tablet" if k == 5 else "pc"
        twin = rank_domain(spark.createDataFrame([(n, domain, v) for n, v in seen.items()], "name string, domain string, rank_utility double"), refs).filter("not is_reference")
        columns = ["name", "rank_utility", "estimated_rank_1_is_best", "rank_percentile", "expected_pairwise_win_percent"]
        got, want = (sorted(tuple(r) for r in d.select(*columns).collect()) for d in (session.ranking(refs), twin))
        assert [g[0] for g in got] == [w[0] for w in want] and all(g[1:] == pytest.approx(w[1:], abs=1e-9) for g, w in zip(got, want))
    assert session.ranking(refs, 2).count() == 16
    written = {i: spark.read.parquet(str(tmp_path / "state" / "changes" / f"batch={i}")).count() for i in (0, 1, 2, 3, 5)}
    assert written == {0: 8, 1: 8, 2: 8, 3: 8, 5: 1} and not os.path.exists(tmp_path / "state" / "changes" / "batch=4")
