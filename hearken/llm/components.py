"""Connected components of a link table, entirely in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import join_hot, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step: ties the neighbours of every node (the larger ones, or the smaller ones and itself) to the least of them.

    The minimum is combined map-side and joined back, and nodes with very many neighbours are
    joined where those lie (``join_hot``), so no node's neighbours are ever gathered.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
        ties = join_hot(both.filter("v > u"), least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        ties = join_hot(down, least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return ties.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every node of ``links`` (columns u, v); the root is the least id of the component.

    Large-star and small-star steps alternate until nothing changes; each round is a
    written table. The number of rounds grows with the logarithm of the longest path.
    """
    edges = stored(links.select("u", "v").filter("u <> v").distinct())
    before = _state(edges)
    while before[0]:
        edges = stored(_star(stored(_star(edges, True, before[0])), False, before[0]))
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("root", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
