"""Splits and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearken.operators.numbering import numbered
from hearken.operators.skew import keyed_join


def split_one_per_group(df: DataFrame, keys: Sequence[str], ident: str, seed: int) -> DataFrame:
    """Add ``is_train``: one pseudo-random row per group trains, the rest validate.

    The draw is the smallest hash of (seed, id) in the group, found by an aggregate and
    joined back: deterministic, independent of partitioning, and no group is sorted.
    """
    draw = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys], F.col(ident))
    chosen = df.groupBy(*keys).agg(F.min(F.struct(draw.alias("h"), F.col(ident).alias("id"))).alias("__pick"))
    out = keyed_join(df, chosen, keys)
    return out.withColumn("is_train", F.col(ident).eqNullSafe(F.col("__pick.id"))).drop("__pick")


def assign_folds(df: DataFrame, ident: str, kind: str = "kfold", k: int = 5, seed: int = 0) -> DataFrame:
    """Add ``fold`` (NULL when there are too few rows or groups).

    * ``kfold``: shuffled row folds, ``min(k, n)`` of them, none below four rows;
    * ``group``: whole groups of ``ident``, at most ``k`` folds, none below three groups;
      groups go round robin by falling size;
    * ``leave_one_out``: one fold per group.

    Positions come from ranges of the order (``numbered``), whatever the ids or sizes have in common.
    """
    if kind == "kfold":
        units = df.groupBy(ident).agg(F.count(F.lit(1)).alias("__size")).withColumn("__h", F.xxhash64(F.lit(seed), F.col(ident)))
        least, most = 4, k
    elif kind in ("group", "leave_one_out"):
        units = df.groupBy(ident).agg(F.count(F.lit(1)).alias("__size"))
        least, most = (3, k) if kind == "group" else (1, None)
    else:
        raise ValueError(f"Unknown fold kind: {kind}")
    order = {"group": [F.desc("__size"), F.asc(ident)], "kfold": [F.asc("__h"), F.asc(ident)], "leave_one_out": [F.asc(ident)]}[kind]
    units = numbered(units, [], order, "__pos")
    count = F.col("__count")
    units = keyed_join(units, units.agg(F.count(F.lit(1)).alias("__count")), [], small=True)  # one row
    fold = F.col("__pos") if most is None else F.pmod("__pos", F.least(count, F.lit(most)))
    units = units.withColumn("fold", F.when(count >= least, fold).cast("int")).select(ident, "fold")
    return keyed_join(df, units, [ident], "left")


def expand_folds(rows: DataFrame, folds: DataFrame, key: Sequence[str] = ("subdir",), fold: str = "fold") -> DataFrame:
    """Copy rows to every exclusion set of their subdir that does not name their fold.

    ``folds`` has one row per (key, excl) and is bounded by the number of folds.
    """
    return keyed_join(rows, folds, key).filter(~F.array_contains("excl", F.col(fold)))


def best_candidate(metrics: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the smallest loss; ties by the remaining order columns (nulls last)."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*[F.asc_nulls_last(c) for c in order])
    return metrics.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def modal_spec(selection: DataFrame, spec: Sequence[str], fold: str) -> DataFrame:
    """Spec chosen most often over the folds; a tie goes to the one seen in the first fold."""
    votes = selection.groupBy(*spec).agg(F.count(F.lit(1)).alias("votes"), F.min(fold).alias("first_fold"))
    return votes.orderBy(F.desc("votes"), F.asc("first_fold")).limit(1)
