"""The driver tables in the shapes of the engine, for Spark and as SQL.

Every adapter reads its whole tables. A device is a supplier (or, for the fold
lattice, the nation of a supplier), a subdir is a return flag, a window is a line
item. Item keys are chosen so that single-item subdirs (A), complete ones (N) and
ones with natural holes (R) all occur.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.operators.rollup import windows_to_x_metrics
from hearken.session import materialise


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _dev(col: str):
    return F.concat(F.lit("dev_"), F.lpad(F.col(col).cast("string"), 5, "0"))


def _nat(col: str):
    return F.concat(F.lit("nat_"), F.lpad(F.col(col).cast("string"), 2, "0"))


# Odd divisors keep averages off decimal rounding ties, so that both engines round alike.
_METRICS = {
    "kl_mean": "l_quantity / 7.30013",
    "kl_var": "l_tax / 3.70019",
    "js_mean": "l_discount / 0.590027",
    "js_var": "l_tax / 11.00017",
    "l2": "l_extendedprice / 9973.177",
    "cos_sim": "0.95 - l_quantity / 57.00031",
    "l2_var": "l_discount / 7.00027",
    "cos_sim_var": "l_tax / 13.00021",
}
_METRIC_SQL = ", ".join(f"{e} AS {c}" for c, e in _METRICS.items())


def _lines(df: DataFrame, name) -> DataFrame:
    line = F.col("l_linenumber").cast("string")
    bucket = F.floor(F.col("l_quantity") / 10.0).cast("string")
    item = F.when(F.col("l_returnflag") == "A", F.lit("all")).when(F.col("l_returnflag") == "N", line)
    return df.select(
        name.alias("name"), F.col("l_returnflag").alias("subdir"), item.otherwise(F.concat_ws("-", line, bucket)).alias("audio_index"),
        F.concat(F.lit("src_"), line).alias("original_file"), F.col("l_linestatus").alias("test_file"),
        F.col("l_orderkey").alias("time_segment"), *[F.expr(re.sub(r"(\d+\.\d+)", r"\1D", e)).alias(c) for c, e in _METRICS.items()],
    )


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(load(spark, sf, "lineitem"), _dev("l_suppkey"))


_ITEM_SQL = """CASE WHEN l_returnflag = 'A' THEN 'all' WHEN l_returnflag = 'N' THEN CAST(l_linenumber AS VARCHAR)
    ELSE CAST(l_linenumber AS VARCHAR) || '-' || CAST(CAST(floor(l_quantity / 10.0) AS BIGINT) AS VARCHAR) END"""
_WINDOW_SQL = f"""l_returnflag AS subdir, {_ITEM_SQL} AS audio_index, 'src_' || l_linenumber AS original_file,
    l_linestatus AS test_file, l_orderkey AS time_segment, {_METRIC_SQL}"""
WINDOWS = f"""windows AS (SELECT 'dev_' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS name, {_WINDOW_SQL} FROM lineitem)"""

_X_SQL = """count(*) AS n_windows, avg(kl_mean) AS kl_mean, coalesce(var_samp(kl_mean), 0) AS kl_var,
    avg(js_mean) AS js_mean, coalesce(var_samp(js_mean), 0) AS js_var, avg(l2) AS l2_mean, coalesce(var_samp(l2), 0) AS l2_var,
    avg(cos_sim) AS cosim_mean, coalesce(var_samp(cos_sim), 0) AS cosim_var"""
XM = f"""{WINDOWS}, xm AS (SELECT name, subdir, audio_index AS x, {_X_SQL} FROM windows GROUP BY 1, 2, 3)"""


def x_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The item table, written once per query as it would arrive in use."""
    return materialise(windows_to_x_metrics(windows(spark, sf)))


def overall_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers in arrears were not rated."""
    s = load(spark, sf, "supplier").filter("s_acctbal >= 0")
    return s.select(_dev("s_suppkey").alias("name"), (60.0 + F.col("s_acctbal") / 337.0).alias("overall_human_score"))


OV = """ov AS (SELECT 'dev_' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS name, 60.0 + s_acctbal / 337.0 AS overall_human_score
    FROM supplier WHERE s_acctbal >= 0)"""


def subdir_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings per task; suppliers of region 4 were not rated for task R."""
    s = load(spark, sf, "supplier").join(F.broadcast(load(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    tasks = F.explode(F.array(*[F.struct(F.lit(n).alias("subdir"), F.lit(k).alias("k")) for n, k in (("A", 1), ("N", 2), ("R", 3))]))
    t = s.select("s_suppkey", "s_acctbal", "s_nationkey", "n_regionkey", tasks.alias("t")).filter("t.subdir <> 'R' OR n_regionkey <> 4")
    return t.select(
        _dev("s_suppkey").alias("name"), F.col("t.subdir").alias("subdir"),
        (60.0 + F.col("s_acctbal") / 337.0 + F.col("t.k") * F.sin(F.col("s_suppkey") + F.col("t.k"))).alias("human_score"),
    )


SUB = """sub AS (SELECT 'dev_' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS name, f.subdir,
    60.0 + s_acctbal / 337.0 + f.k * sin(s_suppkey + f.k) AS human_score
    FROM supplier JOIN nation ON s_nationkey = n_nationkey CROSS JOIN (VALUES ('A', 1), ('N', 2), ('R', 3)) AS f(subdir, k)
    WHERE f.subdir <> 'R' OR n_regionkey <> 4)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Subdir labels with a closed-form prediction from the item table: (name, subdir, truth, pred)."""
    p = x_metrics(spark, sf).groupBy("name", "subdir").agg((100.0 * F.avg("cosim_mean") + 3.0 * F.avg("l2_mean")).alias("pred"))
    return subdir_labels(spark, sf).join(p, ["name", "subdir"]).select("name", "subdir", F.col("human_score").alias("truth"), F.round("pred", 9).alias("pred"))


SCORED = f"""{XM}, {SUB}, scored AS (SELECT sub.name, sub.subdir, human_score AS truth, round(p.pred, 9) AS pred FROM sub JOIN
    (SELECT name, subdir, 100.0 * avg(cosim_mean) + 3.0 * avg(l2_mean) AS pred FROM xm GROUP BY 1, 2) p
    ON p.name = sub.name AND p.subdir = sub.subdir)"""


def scored_overall(spark: SparkSession, sf: str) -> DataFrame:
    p = x_metrics(spark, sf).groupBy("name").agg((60.0 + 40.0 * F.avg("cosim_mean")).alias("pred"))
    return overall_labels(spark, sf).join(p, "name").select("name", F.col("overall_human_score").alias("truth"), F.round("pred", 9).alias("pred"))


SCORED_OV = f"""{XM}, {OV}, scored_ov AS (SELECT ov.name, overall_human_score AS truth, round(p.pred, 9) AS pred FROM ov JOIN
    (SELECT name, 60.0 + 40.0 * avg(cosim_mean) AS pred FROM xm GROUP BY 1) p ON p.name = ov.name)"""


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Frequencies of part classes per supplier and line number; open and filled lines are the two sides."""
    g = (
        load(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("pair_key"), F.when(F.col("l_linestatus") == "O", "p").otherwise("q").alias("side"),
                 F.col("l_linenumber").cast("long").alias("step"), F.pmod("l_partkey", F.lit(20)).alias("token_id"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    tot = g.groupBy("pair_key", "side", "step").agg(F.sum("c").alias("t"))
    return g.join(tot, ["pair_key", "side", "step"]).select(
        "pair_key", "side", "step", "token_id", F.ln(F.col("c").cast("double") / F.col("t")).alias("logprob"))


TOKENS = """tok AS (SELECT pair_key, side, step, token_id,
    ln(CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY pair_key, side, step)) AS logprob
    FROM (SELECT l_suppkey AS pair_key, CASE WHEN l_linestatus = 'O' THEN 'p' ELSE 'q' END AS side, CAST(l_linenumber AS BIGINT) AS step,
        l_partkey % 20 AS token_id, count(*) AS c FROM lineitem GROUP BY 1, 2, 3, 4) g)"""


def vec_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector with the next one."""
    e = load(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("pair_key"), F.col("embedding").alias("test"))
    return e.select(F.col("vec_id").alias("pair_key"), F.col("embedding").alias("ref")).join(nxt, "pair_key")


VEC = "vp AS (SELECT r.vec_id AS pair_key, r.embedding AS ref, t.embedding AS test FROM embeddings r JOIN embeddings t ON t.vec_id = r.vec_id + 1)"


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Six-hour levels per user."""
    e = load(spark, sf, "events")
    hour = (F.dayofmonth("ts") - 1) * 24 + F.hour("ts")
    return e.groupBy(F.col("user_id").alias("recording_id"), F.floor(hour / 6.0).cast("long").alias("frame")).agg(
        (20.0 * F.log10(F.sqrt(F.avg(F.col("value") * F.col("value")) + 1e-12) + 1e-12)).alias("db"))


FRAMES = """frames AS (SELECT user_id AS recording_id, CAST(floor(((day(ts) - 1) * 24 + hour(ts)) / 6.0) AS BIGINT) AS frame,
    20.0 * log10(sqrt(avg(value * value) + 1e-12) + 1e-12) AS db FROM events GROUP BY 1, 2)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as an hourly series (sum of values, 0 where nothing happened is left out)."""
    e = load(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("series"), ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).cast("long").alias("i")).agg(
        (F.sum("value") / 1000.0).alias("value"))


SAMPLES = """samples AS (SELECT user_id AS series, CAST((day(ts) - 1) * 24 + hour(ts) AS BIGINT) AS i, sum(value) / 1000.0 AS value
    FROM events GROUP BY 1, 2)"""


def auxiliary(spark: SparkSession, sf: str) -> DataFrame:
    """Domain and two auxiliary scores per supplier."""
    s = load(spark, sf, "supplier").join(F.broadcast(load(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(
        _dev("s_suppkey").alias("name"), F.when(F.col("n_regionkey").isin(2, 3), " Tablet").otherwise("PC ").alias("domain"),
        (70.0 + F.sin("s_suppkey") * 9).alias("loudness"), (60.0 + F.col("s_acctbal") / 511.0).alias("dynamics"))


AUX = """aux_raw AS (SELECT 'dev_' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS name,
    CASE WHEN n_regionkey IN (2, 3) THEN ' Tablet' ELSE 'PC ' END AS domain, 70.0 + sin(s_suppkey) * 9 AS loudness,
    60.0 + s_acctbal / 511.0 AS dynamics FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    aux AS (SELECT name, lower(trim(domain)) AS domain, loudness, dynamics FROM aux_raw)"""


def nation_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Devices are supplier nations (at most 25, at any scale); items are line numbers or status and quantity classes."""
    li = load(spark, sf, "lineitem").join(load(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    w = _lines(li, _nat("s_nationkey"))
    coarse = F.concat_ws("-", F.col("test_file"), F.substring_index("audio_index", "-", -1))
    return w.withColumn("audio_index", F.when(F.col("subdir") == "R", coarse).otherwise(F.col("audio_index")))


_NAT_ITEM_SQL = """CASE WHEN l_returnflag = 'A' THEN 'all' WHEN l_returnflag = 'N' THEN CAST(l_linenumber AS VARCHAR)
    ELSE l_linestatus || '-' || CAST(CAST(floor(l_quantity / 10.0) AS BIGINT) AS VARCHAR) END"""
NAT_XM = f"""nat_windows AS (SELECT 'nat_' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS name,
    {_WINDOW_SQL.replace(_ITEM_SQL, _NAT_ITEM_SQL)} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    xm AS (SELECT name, subdir, audio_index AS x, {_X_SQL} FROM nat_windows GROUP BY 1, 2, 3)"""


def nation_x(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(windows_to_x_metrics(nation_windows(spark, sf)))


def nation_overall(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier")
    return s.groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("b")).select(
        _nat("s_nationkey").alias("name"), (40.0 + F.col("b") / 137.0).alias("overall_human_score"))


NAT_OV = """ov AS (SELECT 'nat_' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS name, 40.0 + avg(s_acctbal) / 137.0 AS overall_human_score
    FROM supplier GROUP BY s_nationkey)"""


def nation_subdir(spark: SparkSession, sf: str) -> DataFrame:
    """Nations of region 4 were not rated for task R."""
    n = load(spark, sf, "nation").select(_nat("n_nationkey").alias("name"), "n_regionkey", "n_nationkey")
    tasks = F.explode(F.array(*[F.struct(F.lit(s).alias("subdir"), F.lit(k).alias("k")) for s, k in (("A", 1), ("N", 2), ("R", 3))]))
    t = nation_overall(spark, sf).join(n, "name").select("*", tasks.alias("t")).filter("t.subdir <> 'R' OR n_regionkey <> 4")
    return t.select("name", F.col("t.subdir").alias("subdir"),
                    (F.col("overall_human_score") + F.col("t.k") * F.sin(F.col("n_nationkey") + F.col("t.k"))).alias("human_score"))


NAT_SUB = f"""sub AS (SELECT ov.name, f.subdir, overall_human_score + f.k * sin(n_nationkey + f.k) AS human_score FROM ov
    JOIN nation ON ov.name = 'nat_' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')
    CROSS JOIN (VALUES ('A', 1), ('N', 2), ('R', 3)) AS f(subdir, k) WHERE f.subdir <> 'R' OR n_regionkey <> 4)"""
