"""Data-quality rules, reports, label joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as A
from checks.registry import check, r, tidy
from hearken.config import METRICS
from hearken.functions import directions
from hearken.operators import joins as J
from hearken.operators import quality as Q
from hearken.operators.skew import keyed_join

# A raw table with every kind of defect, driven by the data: text numbers, holes, infinities, negative values, repeats.
DIRTY_COLS = ("kl_var", "js_mean", "js_var", "l2_mean", "l2_var", "cosim_mean", "cosim_var")
DIRTY = f"""{A.WINDOWS}, dirty AS (SELECT CASE WHEN l2 > 9.4 THEN NULL ELSE name END AS name, subdir, audio_index AS x,
    CASE WHEN js_mean > 0.16 AND cos_sim > 0.9 THEN '2.5' ELSE '3' END AS n_windows,
    CASE WHEN l2 < 0.15 THEN 'n/a' WHEN l2 < 0.25 THEN 'Infinity' WHEN l2 < 0.4 THEN '-0.5' ELSE CAST(2.5 AS VARCHAR) END AS kl_mean,
    CASE WHEN l2 > 9.2 THEN '-1' ELSE '0.5' END AS kl_var, '0.1' AS js_mean, '0.1' AS js_var, '1' AS l2_mean, '0.1' AS l2_var, '0.5' AS cosim_mean, '0.1' AS cosim_var FROM windows)"""


def dirty(spark, sf):
    w = A.windows(spark, sf)
    l2 = F.col("l2")
    return w.select(
        F.when(l2 > 9.4, None).otherwise(F.col("name")).alias("name"), "subdir", F.col("audio_index").alias("x"),
        F.when((F.col("js_mean") > 0.16) & (F.col("cos_sim") > 0.9), "2.5").otherwise("3").alias("n_windows"),
        F.when(l2 < 0.15, "n/a").when(l2 < 0.25, "Infinity").when(l2 < 0.4, "-0.5").otherwise("2.5").alias("kl_mean"),
        F.when(l2 > 9.2, "-1").otherwise("0.5").alias("kl_var"),
        *[F.lit(v).alias(c) for c, v in zip(DIRTY_COLS[1:], ("0.1", "0.1", "1", "0.1", "0.5", "0.1"))])


VIOL = f"""{DIRTY}, viol AS (SELECT 'null_key' AS rule, name, subdir, x FROM dirty WHERE name IS NULL
    UNION ALL SELECT 'non_numeric', name, subdir, x FROM dirty WHERE TRY_CAST(kl_mean AS DOUBLE) IS NULL
    UNION ALL SELECT 'infinite', name, subdir, x FROM dirty WHERE kl_mean = 'Infinity'
    UNION ALL SELECT 'bad_n_windows', name, subdir, x FROM dirty WHERE n_windows = '2.5'
    UNION ALL SELECT 'neg_var', name, subdir, x FROM dirty WHERE kl_var = '-1'
    UNION ALL SELECT 'neg_mean', name, subdir, x FROM dirty WHERE kl_mean = '-0.5'
    UNION ALL SELECT 'duplicate_key', d.name, d.subdir, d.x FROM dirty d JOIN (SELECT name, subdir, x FROM dirty GROUP BY 1, 2, 3 HAVING count(*) > 1) k
        ON k.name IS NOT DISTINCT FROM d.name AND k.subdir = d.subdir AND k.x = d.x)"""


@check("b2_b7_violations", f"WITH {VIOL} SELECT rule, coalesce(name, '') AS name, subdir, x, count(*) AS n FROM viol GROUP BY ALL")
def b2(spark, sf):
    v = Q.violations(dirty(spark, sf))
    return tidy(v.groupBy("rule", F.coalesce("name", F.lit("")).alias("name"), "subdir", "x").agg(F.count(F.lit(1)).alias("n")))


@check("f4_first_examples", f"WITH {VIOL} SELECT rule, coalesce(name, '') AS name, subdir, x FROM viol WHERE name IS NOT NULL ORDER BY rule, name, subdir, x LIMIT 10")
def f4(spark, sf):
    v = Q.violations(dirty(spark, sf)).filter("name IS NOT NULL")
    return tidy(Q.examples(v, ["rule", "name", "subdir", "x"], 10))


@check("b3_keys_to_string", "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS name, CAST(l_linenumber AS VARCHAR) AS x FROM lineitem")
def b3(spark, sf):
    li = A.load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("name"), F.col("l_linenumber").alias("x"))
    return J.keys_to_string(li, ["name", "x"]).distinct()


@check("b4_duplicate_keys", f"WITH {A.WINDOWS} SELECT name, subdir, audio_index, count(*) AS n_rows FROM windows GROUP BY 1, 2, 3 HAVING count(*) > 1")
def b4(spark, sf):
    return tidy(Q.repeated_keys(A.windows(spark, sf), ["name", "subdir", "audio_index"]))


@check("b5_numeric_coercion", f"WITH {DIRTY} SELECT kl_mean AS raw, {r('CASE WHEN isinf(TRY_CAST(kl_mean AS DOUBLE)) THEN NULL ELSE TRY_CAST(kl_mean AS DOUBLE) END')} AS value, count(*) AS n FROM dirty GROUP BY 1, 2")
def b5(spark, sf):
    from hearken.functions.exprs import finite_or_null

    d = dirty(spark, sf).withColumn("value", finite_or_null(Q.as_number(F.col("kl_mean"))))
    return tidy(d.groupBy(F.col("kl_mean").alias("raw"), "value").agg(F.count(F.lit(1)).alias("n")))


@check("b6_count_rule", "SELECT CAST(l_quantity AS BIGINT) AS q, CAST(l_quantity >= 1 AND abs(l_quantity + l_tax - round(l_quantity + l_tax)) <= 1e-8 + 1e-5 * abs(round(l_quantity + l_tax)) AS BIGINT) AS ok, count(*) AS n FROM lineitem GROUP BY 1, 2")
def b6(spark, sf):
    li = A.load(spark, sf, "lineitem")
    return tidy(li.groupBy(F.col("l_quantity").cast("long").alias("q"), Q.is_count(F.col("l_quantity") + F.col("l_tax")).alias("ok")).agg(F.count(F.lit(1)).alias("n")))


@check("b8_validation_report", f"""WITH {A.XM} SELECT subdir AS scope, count(*) AS num_rows, count(DISTINCT name) AS num_devices, count(DISTINCT x) AS num_x, CAST(1 AS BIGINT) AS num_subdirs FROM xm GROUP BY 1
    UNION ALL SELECT 'ALL', count(*), count(DISTINCT name), count(DISTINCT x), count(DISTINCT subdir) FROM xm""")
def b8(spark, sf):
    return tidy(Q.validation_report(A.x_metrics(spark, sf)))


@check("b9_label_report", f"""WITH {A.SUB}, {A.OV} SELECT subdir AS scope, count(*) AS num_labels, count(DISTINCT name) AS num_devices FROM sub GROUP BY 1
    UNION ALL SELECT 'ALL_SUBDIRS', count(*), count(DISTINCT name) FROM sub UNION ALL SELECT 'OVERALL', count(*), count(DISTINCT name) FROM ov""")
def b9(spark, sf):
    return tidy(Q.validate_labels(A.subdir_labels(spark, sf), A.overall_labels(spark, sf)))


# Labels with text scores, holes and repeats.
MESSY = f"""{A.SUB}, messy AS (SELECT name, subdir, CASE WHEN human_score > 88 THEN 'unknown' WHEN human_score > 86 THEN NULL ELSE CAST(round(human_score, 3) AS VARCHAR) END AS human_score FROM sub
    UNION ALL SELECT name, subdir, '50' FROM sub WHERE human_score < 62),
    mt AS (SELECT name, subdir, TRY_CAST(human_score AS DOUBLE) AS s FROM messy), dupk AS (SELECT name, subdir FROM mt WHERE s IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
    uq AS (SELECT * FROM mt WHERE s IS NOT NULL AND (name, subdir) NOT IN (SELECT (name, subdir) FROM dupk)),
    ft AS (SELECT DISTINCT name, subdir FROM windows)"""


def messy(spark, sf):
    s = A.subdir_labels(spark, sf)
    h = F.col("human_score")
    text = F.when(h > 88, "unknown").when(h > 86, None).otherwise(F.round(h, 3).cast("string"))
    return s.select("name", "subdir", text.alias("human_score")).unionByName(s.filter(h < 62).select("name", "subdir", F.lit("50").alias("human_score")))


def features(spark, sf):
    return A.windows(spark, sf).select("name", "subdir").distinct()


@check("b10_split_labels", f"""WITH {A.WINDOWS}, {MESSY} SELECT 'invalid' AS part, name, subdir, 'invalid_human_score' AS reason, CAST(NULL AS DOUBLE) AS score FROM mt WHERE s IS NULL
    UNION ALL SELECT 'duplicate', mt.name, mt.subdir, 'duplicate_human_score', {r('s')} FROM mt JOIN dupk ON dupk.name = mt.name AND dupk.subdir = mt.subdir WHERE s IS NOT NULL
    UNION ALL SELECT 'unlabeled', ft.name, ft.subdir, 'missing_human_score_for_name_subdir', NULL FROM ft LEFT JOIN uq ON uq.name = ft.name AND uq.subdir = ft.subdir WHERE s IS NULL
    UNION ALL SELECT 'labeled', ft.name, ft.subdir, '', {r('s')} FROM ft JOIN uq ON uq.name = ft.name AND uq.subdir = ft.subdir""")
def b10(spark, sf):
    parts = Q.split_labels(features(spark, sf), messy(spark, sf))
    out = None
    for name, df in parts.items():
        reason = F.col("skip_reason") if "skip_reason" in df.columns else F.lit("")
        row = df.select(F.lit(name).alias("part"), "name", "subdir", reason.alias("reason"), F.col("human_score").alias("score"))
        out = row if out is None else out.unionByName(row)
    return tidy(out)


@check("b11_match_summary", f"""WITH {A.WINDOWS}, {MESSY}, m AS (SELECT ft.name, s FROM ft LEFT JOIN uq ON uq.name = ft.name AND uq.subdir = ft.subdir)
    SELECT count(*) AS total_rows, count(s) AS matched_rows, count(*) - count(s) AS skipped_rows, {r('count(s) / CAST(count(*) AS DOUBLE)')} AS matched_ratio,
    count(DISTINCT CASE WHEN s IS NOT NULL THEN name END) AS labeled_devices, CAST(count(s) >= 1 AND count(DISTINCT CASE WHEN s IS NOT NULL THEN name END) >= 2 AS BIGINT) AS trainable FROM m""")
def b11(spark, sf):
    parts = Q.split_labels(features(spark, sf), messy(spark, sf))
    both = parts["labeled"].select("name", "human_score").unionByName(parts["unlabeled"].select("name", "human_score"))
    return tidy(Q.match_summary(both))


@check("b14_metric_directions", "SELECT " + ", ".join(f"{r(f'sum({c} * {s})', 3)} AS {c}" for c, s in (
    ("l2_similarity", -1), ("score", 1), ("loudness", 1), ("pesq", -1))) +
    " FROM (SELECT l_quantity AS l2_similarity, l_discount AS score, l_tax AS loudness, l_quantity / 3.0 AS pesq FROM lineitem)")
def b14(spark, sf):
    """The lower-is-better fragment wins in l2_similarity; pesq is overridden."""
    li = A.load(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("l2_similarity"), F.col("l_discount").alias("score"), F.col("l_tax").alias("loudness"), (F.col("l_quantity") / 3.0).alias("pesq"))
    cols = li.columns
    return tidy(directions.apply_directions(li, cols, {"pesq": "lower"}).agg(*[F.sum(c).alias(c) for c in cols]), 3)


@check("b15_feature_columns", "SELECT " + ", ".join(f"count({c}) AS {c}" for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")) + " FROM lineitem")
def b15(spark, sf):
    li = A.load(spark, sf, "lineitem")
    cols = directions.feature_columns(li, ["l_quantity", "l_orderkey"])
    return tidy(li.agg(*[F.count(c).alias(c) for c in cols]))


USABLE = ("l_quantity", "l_discount", "constant", "mostly_null", "with_inf")


@check("b16_usable_features", """WITH t AS (SELECT l_returnflag AS subdir, l_quantity, l_discount, 1.0 AS constant, CASE WHEN l_orderkey < 2 AND l_linenumber = 1 THEN l_tax END AS mostly_null,
    CASE WHEN l_quantity > 25 THEN CAST('inf' AS DOUBLE) ELSE 3.0 END AS with_inf FROM lineitem), """ + "u AS (" + " UNION ALL ".join(
    f"SELECT subdir, '{c}' AS feature, count(CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN {c} END) AS n_finite, count(DISTINCT CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN {c} END) AS d FROM t GROUP BY 1" for c in USABLE)
    + ") SELECT subdir, feature, n_finite, CAST(d >= 2 AS BIGINT) AS varies, CAST(n_finite >= 2 AND d >= 2 AS BIGINT) AS usable FROM u")
def b16(spark, sf):
    li = A.load(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("subdir"), "l_quantity", "l_discount", F.lit(1.0).alias("constant"),
        F.when((F.col("l_orderkey") < 2) & (F.col("l_linenumber") == 1), F.col("l_tax")).alias("mostly_null"),
        F.when(F.col("l_quantity") > 25, F.lit(float("inf"))).otherwise(F.lit(3.0)).alias("with_inf"))
    return tidy(Q.usable_features(li, USABLE, ["subdir"]))


@check("b17_drop_null_targets", f"WITH {MESSY.replace(', ft AS (SELECT DISTINCT name, subdir FROM windows)', '')} SELECT name, subdir, {r('s')} AS human_score FROM mt WHERE s IS NOT NULL".replace(",\n    ft AS (SELECT DISTINCT name, subdir FROM windows)", ""))
def b17(spark, sf):
    m = messy(spark, sf).withColumn("human_score", Q.as_number(F.col("human_score")))
    return tidy(J.with_target(m, "human_score", "name"))


@check("b19_domain_label", f"WITH {A.AUX} SELECT domain, CASE domain WHEN 'pc' THEN 'PC' WHEN 'tablet' THEN 'Tablet' ELSE '设备' END AS label, count(*) AS n FROM aux GROUP BY 1, 2")
def b19(spark, sf):
    from hearken.plans.domains import domain_label
    from hearken.sources.tables import read_auxiliary

    a = read_auxiliary(A.auxiliary(spark, sf))
    return tidy(a.groupBy("domain", domain_label(F.col("domain")).alias("label")).agg(F.count(F.lit(1)).alias("n")))


@check("c1_join_labels_inner", f"WITH {A.XM}, {A.SUB}, a AS (SELECT name, subdir, count(*) AS n_x FROM xm GROUP BY 1, 2) SELECT a.name, a.subdir, n_x, {r('human_score')} AS human_score FROM a JOIN sub ON sub.name = a.name AND sub.subdir = a.subdir")
def c1(spark, sf):
    a = A.x_metrics(spark, sf).groupBy("name", "subdir").agg(F.count(F.lit(1)).alias("n_x"))
    return tidy(J.join_labels(a, A.subdir_labels(spark, sf)))


@check("c2_join_labels_left", f"WITH {A.XM}, {A.SUB}, a AS (SELECT name, subdir, count(*) AS n_x FROM xm GROUP BY 1, 2) SELECT a.name, a.subdir, n_x, {r('human_score')} AS human_score, CAST(human_score IS NOT NULL AS BIGINT) AS matched FROM a LEFT JOIN sub ON sub.name = a.name AND sub.subdir = a.subdir")
def c2(spark, sf):
    a = A.x_metrics(spark, sf).groupBy("name", "subdir").agg(F.count(F.lit(1)).alias("n_x"))
    return tidy(J.join_labels(a, A.subdir_labels(spark, sf), how="left"))


@check("c3_unlabeled", f"WITH {A.XM}, {A.SUB} SELECT name, subdir, count(*) AS n FROM xm WHERE (name, subdir) NOT IN (SELECT (name, subdir) FROM sub) GROUP BY 1, 2")
def c3(spark, sf):
    x = J.unlabeled(A.x_metrics(spark, sf), A.subdir_labels(spark, sf))
    return tidy(x.groupBy("name", "subdir").agg(F.count(F.lit(1)).alias("n")))


@check("c4_available_devices", f"WITH {A.XM}, {A.SUB} SELECT DISTINCT xm.subdir, xm.name FROM xm JOIN sub ON sub.name = xm.name AND sub.subdir = xm.subdir")
def c4(spark, sf):
    return J.available_devices(A.x_metrics(spark, sf), A.subdir_labels(spark, sf))


@check("g2_common_subdirs", f"WITH {A.XM}, {A.SUB} SELECT DISTINCT subdir FROM xm WHERE subdir IN (SELECT subdir FROM sub)")
def g2(spark, sf):
    return J.common(A.x_metrics(spark, sf), A.subdir_labels(spark, sf), ["subdir"])


@check("g1_union_of_results", f"WITH {A.XM}, {A.OV} SELECT 'items' AS part, subdir, name, CAST(n_windows AS DOUBLE) AS value FROM xm UNION ALL SELECT 'overall', NULL, name, {r('overall_human_score')} FROM ov")
def g1(spark, sf):
    from hearken.sources.sinks import union_rows

    a = A.x_metrics(spark, sf).select(F.lit("items").alias("part"), "subdir", "name", F.col("n_windows").cast("double").alias("value"))
    b = A.overall_labels(spark, sf).select(F.lit("overall").alias("part"), "name", F.col("overall_human_score").alias("value"))
    return tidy(union_rows(a, b))


@check("g4_distinct_by_key", f"WITH {A.WINDOWS} SELECT DISTINCT name, subdir, original_file FROM windows")
def g4(spark, sf):
    return A.windows(spark, sf).select("name", "subdir", "original_file").dropDuplicates(["name", "subdir", "original_file"])


@check("c10_expand_folds", f"WITH {A.NAT_XM}, d AS (SELECT DISTINCT name FROM xm), f AS (SELECT name, dense_rank() OVER (ORDER BY name) AS fold FROM d) SELECT e.fold AS excluded, xm.subdir, count(*) AS n_rows, count(DISTINCT xm.name) AS n_devices "
       "FROM xm JOIN f ON f.name = xm.name JOIN f e ON e.fold <> f.fold GROUP BY 1, 2")
def c10(spark, sf):
    from hearken.operators.folds import assign_folds, expand_folds

    x = A.nation_x(spark, sf)
    folded = assign_folds(x, "name", "leave_one_out")
    everyone = folded.agg(F.collect_set("fold").alias("all"))
    sets = keyed_join(folded.select("subdir").distinct(), everyone, [], small=True).select("subdir", F.explode("all").alias("f")).select("subdir", F.array("f").alias("excl"))
    out = expand_folds(folded, sets).groupBy((F.col("excl")[0] + 1).alias("excluded"), "subdir").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("name").alias("n_devices"))
    return tidy(out)


@check("e7_split_one_per_group", f"WITH {A.XM}, g AS (SELECT subdir, name, count(*) AS n FROM xm GROUP BY 1, 2) SELECT subdir, count(*) AS n_train, CAST(sum(n - 1) AS BIGINT) AS n_validation FROM g GROUP BY 1")
def e7(spark, sf):
    from hearken.operators.folds import split_one_per_group

    s = split_one_per_group(A.x_metrics(spark, sf), ["subdir", "name"], "x", 7)
    return tidy(s.groupBy("subdir").agg(F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_validation")))


@check("e9_fold_balance", """WITH c AS (SELECT count(*) AS n FROM supplier), f AS (SELECT unnest(range(0, 5)) AS fold) SELECT fold, (n - fold + 4) // 5 AS rows FROM c, f""")
def e9(spark, sf):
    from hearken.operators.folds import assign_folds

    s = assign_folds(A.load(spark, sf, "supplier"), "s_suppkey", "kfold", 5, 3)
    return tidy(s.groupBy("fold").agg(F.count(F.lit(1)).alias("rows")))


@check("e9_group_folds", """WITH g AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1), k AS (SELECT *, (row_number() OVER (ORDER BY n DESC, s_nationkey) - 1) % 5 AS fold FROM g)
    SELECT fold, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows FROM k GROUP BY 1""")
def e9g(spark, sf):
    from hearken.operators.folds import assign_folds

    s = assign_folds(A.load(spark, sf, "supplier"), "s_nationkey", "group", 5)
    return tidy(s.groupBy("fold").agg(F.countDistinct("s_nationkey").alias("groups"), F.count(F.lit(1)).alias("rows")))


@check("h4_safe_names", "SELECT DISTINCT p_name AS raw, regexp_replace(p_name, '[^0-9a-zA-Z._-]+', '_', 'g') AS safe FROM part")
def h4(spark, sf):
    from hearken.functions.exprs import safe_name

    return A.load(spark, sf, "part").select(F.col("p_name").alias("raw"), safe_name(F.col("p_name")).alias("safe")).distinct()
