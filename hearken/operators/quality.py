"""Data-quality checks: one pass that names every broken row, plus reports and label splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.config import KEYS, METRICS, NUMERIC, X_COLUMNS
from hearken.functions.exprs import is_finite
from hearken.operators.skew import keyed_join


def require_columns(df: DataFrame, columns: Sequence[str], allow_empty: bool = True) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    if not allow_empty and df.isEmpty():
        raise ValueError("The metrics table has no rows")
    return df


def as_number(col: Column) -> Column:
    """Numeric value or NULL; never raises under ANSI mode.

    NaN is a missing value and becomes NULL here, at the boundary, so that no aggregate ever
    meets one. Infinities stay: validation rejects them, lenient feature tables null them.
    """
    return F.nanvl(col.try_cast("double"), F.lit(None).cast("double"))


def is_count(col: Column) -> Column:
    """At least one, and an integer up to the usual relative and absolute tolerance."""
    near = F.round(col)
    return (col >= 1) & (F.abs(col - near) <= 1e-8 + 1e-5 * F.abs(near))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row. A map-side aggregate, so a hot key costs one row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def violations(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every broken rule of an item-level metric table: (rule, name, subdir, x).

    Rules: null_key, duplicate_key, non_numeric, infinite, bad_n_windows, neg_var, neg_mean.
    A row appears once per rule it breaks.
    """
    text = {k: F.col(k).cast("string") for k in keys}
    nums = {c: as_number(F.col(c)) for c in NUMERIC}
    typed = df.select(*[c.alias(k) for k, c in text.items()], *[c.alias(k) for k, c in nums.items()])
    null_key = F.lit(False)
    missing, infinite, neg_var, neg_mean = F.lit(False), F.lit(False), F.lit(False), F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    for c in NUMERIC:
        missing = missing | F.col(c).isNull() | F.isnan(F.col(c))
        infinite = infinite | (F.abs(F.col(c)) == float("inf"))
    for m in METRICS:
        neg_var = neg_var | (F.col(m.var) < 0)
        if m.transform == "log1p":
            neg_mean = neg_mean | (F.col(m.mean) < 0)
    rules = {
        "null_key": null_key,
        "non_numeric": missing,
        "infinite": infinite,
        "bad_n_windows": ~is_count(F.col("n_windows")) & ~F.isnan("n_windows"),
        "neg_var": neg_var,
        "neg_mean": neg_mean,
    }
    flagged = typed.select(
        *keys,
        F.explode(
            F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]), lambda r: r.isNotNull())
        ).alias("rule"),
    )
    duplicates = keyed_join(typed.select(*keys), repeated_keys(typed, keys), keys, nulls=True).select(
        *keys, F.lit("duplicate_key").alias("rule")
    )
    return flagged.unionByName(duplicates).select("rule", *keys)


def clean_x_metrics(df: DataFrame, limit: int = 10) -> DataFrame:
    """Typed item-level table, or an error quoting the first offending rows. Runs one job."""
    require_columns(df, X_COLUMNS, allow_empty=False)
    bad = examples(violations(df), ["rule", *KEYS], limit).collect()
    if bad:
        raise ValueError(f"Invalid metric rows: {[r.asDict() for r in bad]}")
    return df.select(
        *[F.col(k).cast("string").alias(k) for k in ("subdir", "name", "x")],
        F.round(as_number(F.col("n_windows"))).cast("long").alias("n_windows"),
        *[as_number(F.col(c)).alias(c) for c in NUMERIC if c != "n_windows"],
    )


def examples(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """First ``n`` rows in key order (a top-n, not a full sort)."""
    return df.orderBy(*order).limit(n)


def validation_report(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows, devices and distinct items per subdir, plus an ``ALL`` row."""
    name, subdir, x = keys

    def counts(grouped, label):
        return grouped.agg(
            F.count(F.lit(1)).alias("num_rows"),
            F.countDistinct(name).alias("num_devices"),
            F.countDistinct(x).alias("num_x"),
            F.countDistinct(subdir).alias("num_subdirs"),
        ).select(label, "num_rows", "num_devices", "num_x", "num_subdirs")

    return counts(df.groupBy(subdir), F.col(subdir).alias("scope")).unionByName(
        counts(df.groupBy(), F.lit("ALL").alias("scope"))
    )


def validate_labels(sub: DataFrame, overall: DataFrame) -> DataFrame:
    """Label counts per subdir and overall; raises on non-numeric, infinite or repeated labels."""
    for frame, key, score in ((sub, ["name", "subdir"], "human_score"), (overall, ["name"], "overall_human_score")):
        require_columns(frame, [*key, score])
        number = as_number(F.col(score))
        if not frame.filter(~F.coalesce(is_finite(number), F.lit(False))).isEmpty():
            raise ValueError(f"{score} holds non-numeric or infinite values")
        if not repeated_keys(frame, key).isEmpty():
            raise ValueError(f"Duplicate labels for {key}")
    return label_report(sub, overall)


def label_report(sub: DataFrame, overall: DataFrame) -> DataFrame:
    per = sub.groupBy(F.col("subdir").alias("scope")).agg(
        F.count(F.lit(1)).alias("num_labels"), F.countDistinct("name").alias("num_devices")
    )
    both = [
        f.agg(F.count(F.lit(1)).alias("num_labels"), F.countDistinct("name").alias("num_devices")).select(
            F.lit(n).alias("scope"), "num_labels", "num_devices"
        )
        for n, f in (("ALL_SUBDIRS", sub), ("OVERALL", overall))
    ]
    return per.unionByName(both[0]).unionByName(both[1])


def split_labels(features: DataFrame, labels: DataFrame, keys: Sequence[str] = ("name", "subdir")) -> dict[str, DataFrame]:
    """Quarantine instead of reject: usable rows and the three side tables, each with a reason."""
    scored = labels.withColumn("human_score", as_number(F.col("human_score")))
    invalid = scored.filter(F.col("human_score").isNull() | F.isnan("human_score"))
    valid = scored.filter(F.col("human_score").isNotNull() & ~F.isnan("human_score"))
    repeats = repeated_keys(valid, keys).select(*keys)
    duplicate = keyed_join(valid, repeats, keys, "left_semi")
    unique = keyed_join(valid, repeats, keys, "left_anti")
    matched = keyed_join(features, unique, keys, "left")
    reason = "missing_human_score_for_" + "_".join(keys)
    return {
        "invalid": invalid.withColumn("skip_reason", F.lit("invalid_human_score")),
        "duplicate": duplicate.withColumn("skip_reason", F.lit("duplicate_human_score")),
        "unlabeled": matched.filter(F.col("human_score").isNull()).withColumn("skip_reason", F.lit(reason)),
        "labeled": matched.filter(F.col("human_score").isNotNull()),
    }


def match_summary(matched: DataFrame, score: str = "human_score") -> DataFrame:
    """Rows, matched and skipped rows, ratio and number of labelled devices."""
    has = F.col(score).isNotNull()
    return matched.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(has).alias("matched_rows"),
        F.count_if(~has).alias("skipped_rows"),
        F.try_divide(F.count_if(has).cast("double"), F.count(F.lit(1))).alias("matched_ratio"),
        F.countDistinct(F.when(has, F.col("name"))).alias("labeled_devices"),
    ).withColumn("trainable", (F.col("matched_rows") >= 1) & (F.col("labeled_devices") >= 2))


def usable_features(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per feature: finite values and distinct values; usable when both are at least two.

    Distinctness needs no distinct aggregate: two different values exist iff min < max.
    """
    aggs = []
    for c in columns:
        v = F.when(is_finite(F.col(c)), F.col(c))
        aggs += [F.count(v).alias(f"n__{c}"), (F.max(v) > F.min(v)).alias(f"d__{c}")]
    wide = df.groupBy(*keys).agg(*aggs)
    long = wide.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n__{c}").alias("n_finite"), F.coalesce(F.col(f"d__{c}"), F.lit(False)).alias("varies")) for c in columns])
        ).alias("__s"),
    ).select(*keys, "__s.*")
    return long.withColumn("usable", ((F.col("n_finite") >= 2) & F.col("varies")).cast("int"))
