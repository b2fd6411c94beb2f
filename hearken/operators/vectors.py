"""Embedding pooling, pair distances and set distance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, v: acc + v)


def pair_items(ref: DataFrame, test: DataFrame, key: str, value: str = "embedding") -> DataFrame:
    """Reference and test item of each key present on both sides."""
    return ref.select(key, F.col(value).alias("ref")).join(test.select(key, F.col(value).alias("test")), key)


def vector_distances(pairs: DataFrame, ref: str = "ref", test: str = "test") -> DataFrame:
    """Cosine similarity and distance and L2 distance per pair; norms are at least 1e-8."""
    r, t = F.col(ref), F.col(test)
    square = F.zip_with(r, t, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    norm_r = F.greatest(F.sqrt(dot(r, r)), F.lit(1e-8))
    norm_t = F.greatest(F.sqrt(dot(t, t)), F.lit(1e-8))
    cos = dot(r, t) / (norm_r * norm_t)
    return pairs.withColumn("cosine_similarity", cos).withColumns(
        {
            "cosine_distance": 1.0 - F.col("cosine_similarity"),
            "l2_distance": F.sqrt(F.aggregate(square, F.lit(0.0), lambda acc, v: acc + v)),
        }
    )


def pool_embeddings(df: DataFrame, keys: Sequence[str], vector: str = "embedding", how: str = "mean") -> DataFrame:
    """Token vectors to one vector per key: the mean, or the mean followed by the sample std.

    Aggregates per (key, dimension), which combines map-side; only the finished
    vector of one key is put together in one row.
    """
    if how not in ("mean", "mean_std"):
        raise ValueError(f"Unknown pool: {how}")
    per_dim = (
        df.select(*keys, F.posexplode(vector).alias("dim", "v"))
        .groupBy(*keys, "dim")
        .agg(F.avg(F.col("v").cast("double")).alias("m"), F.stddev_samp(F.col("v").cast("double")).alias("s"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("dim", "m", "s")))
    mean = F.transform(ordered, lambda x: x["m"])
    pooled = mean if how == "mean" else F.concat(mean, F.transform(ordered, lambda x: x["s"]))
    return per_dim.groupBy(*keys).agg(pooled.alias("embedding"))


def moments(df: DataFrame, vector: str = "embedding", set_col: str = "side") -> DataFrame:
    """Per set: row count, sum vector and upper Gram sums as (set, i, j, value) rows.

    (i, -1) carries the sum of dimension i, (-1, -1) the row count. Each task
    reduces its Arrow batches with one matrix product and sends d*(d+3)/2+1 numbers
    per batch and set, so the shuffle does not depend on the row count.
    """
    def partial(batches):
        for pdf in batches:
            for side, part in pdf.groupby(set_col, sort=False):
                x = np.stack([np.asarray(v, dtype=np.float64) for v in part[vector]])
                d = x.shape[1]
                i, j = np.triu_indices(d)
                gram = x.T @ x
                yield pd.DataFrame({
                    set_col: side,
                    "i": np.concatenate([i, np.arange(d), [-1]]),
                    "j": np.concatenate([j, np.full(d + 1, -1)]),
                    "value": np.concatenate([gram[i, j], x.sum(axis=0), [float(len(x))]]),
                })

    kind = df.schema[set_col].dataType.simpleString()
    parts = df.select(set_col, vector).mapInPandas(partial, f"{set_col} {kind}, i int, j int, value double")
    return parts.groupBy(set_col, "i", "j").agg(F.sum("value").alias("value"))


def set_summary(mom: DataFrame, set_col: str = "side", ridge: float = 1e-6) -> DataFrame:
    """Row count, mean vector norm squared and covariance trace of each set, from its moments."""
    n = F.max(F.when(F.col("i") == -1, F.col("value")))
    sums = F.sum(F.when((F.col("j") == -1) & (F.col("i") >= 0), F.col("value") * F.col("value")).otherwise(0.0))
    diag = F.sum(F.when((F.col("i") == F.col("j")) & (F.col("i") >= 0), F.col("value")).otherwise(0.0))
    dims = F.count_if((F.col("j") == -1) & (F.col("i") >= 0))
    return mom.groupBy(set_col).agg(
        n.cast("long").alias("n_rows"),
        (sums / (n * n)).alias("mean_norm2"),
        ((diag - sums / n) / (n - 1.0) + ridge * dims).alias("cov_trace"),
    )


def frechet(df: DataFrame, left, right, vector: str = "embedding", set_col: str = "side", ridge: float = 1e-6) -> DataFrame:
    """Fréchet distance between two sets of vectors, with its mean and trace parts.

    Spark reduces the rows to moments; only those d*d numbers per set reach the
    driver, where one symmetric eigen step gives the trace of the matrix root.
    """
    spark = df.sparkSession
    rows = moments(df.filter(F.col(set_col).isin([left, right])), vector, set_col).toPandas()
    stats = {}
    for side in (left, right):
        part = rows[rows[set_col] == side]
        n = float(part.loc[part.i == -1, "value"].sum())
        if n < 2:
            raise ValueError("The Fréchet distance needs at least two vectors per set")
        sums = part[(part.j == -1) & (part.i >= 0)].sort_values("i")["value"].to_numpy()
        d = len(sums)
        gram = np.zeros((d, d))
        cells = part[part.j >= 0]
        gram[cells.i.to_numpy(), cells.j.to_numpy()] = cells["value"].to_numpy()
        gram = gram + np.triu(gram, 1).T
        mean = sums / n
        stats[side] = (n, mean, (gram - n * np.outer(mean, mean)) / (n - 1.0) + ridge * np.eye(d))
    (nl, ml, cl), (nr, mr, cr) = stats[left], stats[right]
    if len(ml) != len(mr):
        raise ValueError(f"Embedding dimension mismatch: {len(ml)} vs {len(mr)}")
    w, v = np.linalg.eigh(cl)
    root = (v * np.sqrt(np.maximum(w, 0.0))) @ v.T
    root_trace = float(np.sum(np.sqrt(np.maximum(np.linalg.eigvalsh(root @ cr @ root), 0.0))))
    mean_part = float((ml - mr) @ (ml - mr))
    total = mean_part + float(np.trace(cl) + np.trace(cr)) - 2.0 * root_trace
    return spark.createDataFrame(
        [(int(nl), int(nr), mean_part, float(np.trace(cl)), float(np.trace(cr)), root_trace, total)],
        "n_left long, n_right long, mean_term double, trace_left double, trace_right double, root_trace double, frechet_distance double",
    )

