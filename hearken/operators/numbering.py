"""Positions of rows in an order, without a task that holds a whole group.

Rows are dealt to ranges of (group, order), so a group of any size, and any run of alike
values, lies on as many tasks as its rows need. A row's position is its place in its range
plus the rows of its group in earlier ranges: one small number per range and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.operators.skew import keyed_join
from hearken.session import materialise

#: ``monotonically_increasing_id`` keeps the row number of a partition in its low 33 bits.
_ROW_BITS = 33


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """Rows with their position (from 0) inside their group.

    ``order`` should be total; rows that are equal in it get positions in no fixed order. The
    ranges are written once, as their bounds must not change between the two readings.
    """
    cols = [*[F.col(k) for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order]]
    laid = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__id", F.monotonically_increasing_id())
    laid = materialise(laid.withColumn("__range", F.shiftright("__id", _ROW_BITS)))
    per = laid.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    # At most one row for each range and group: groups that share a range have one row each.
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.coalesce(F.sum("__n").over(over), F.lit(0)) - F.col("__first")).drop("__n", "__first")
    placed = keyed_join(laid, per, [*keys, "__range"], nulls=True)
    return placed.withColumn(out, F.col("__id") + F.col("__before")).drop("__id", "__range", "__before")
