"""Token distributions and embeddings as long or array tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def token_table(df: DataFrame, kind: str | None = None) -> DataFrame:
    """Long table (pair_key, side, step, token_id, logprob, kind) from any of the dump shapes.

    * ``logprobs``/``full_logprobs``: one array per step, the position is the token id;
    * ``top_token_ids`` with ``top_logprobs``: parallel arrays of the k best tokens;
    * already long: passed through.
    """
    keys = ["pair_key", "side", "step"]
    columns = set(df.columns)
    full = next((c for c in ("logprobs", "full_logprobs", "logp") if c in columns), None)
    if kind in (None, "full") and full:
        return df.select(*keys, F.posexplode(full).alias("token_id", "logprob")).select(
            *keys, F.col("token_id").cast("long").alias("token_id"), F.col("logprob").cast("double").alias("logprob"), F.lit("full").alias("kind")
        )
    if kind in (None, "topk") and {"top_token_ids", "top_logprobs"} <= columns:
        zipped = F.explode(F.arrays_zip("top_token_ids", "top_logprobs"))
        return df.select(*keys, zipped.alias("z")).select(
            *keys, F.col("z.top_token_ids").cast("long").alias("token_id"), F.col("z.top_logprobs").cast("double").alias("logprob"),
            F.lit("topk").alias("kind"),
        )
    if {"token_id", "logprob"} <= columns:
        return df.select(*keys, "token_id", F.col("logprob").cast("double").alias("logprob"), F.lit(kind or "full").alias("kind"))
    raise ValueError(f"Unsupported token table columns: {sorted(columns)}")


def read_tokens(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    return token_table(spark.read.parquet(path), kind)


def read_embeddings(spark: SparkSession, path: str, key: str = "key", vector: str = "embedding") -> DataFrame:
    """(key, embedding) from a columnar file; rows are unordered, sort by key where order matters."""
    return spark.read.parquet(path).select(key, F.col(vector).cast("array<float>").alias("embedding"))


def first_codebook(df: DataFrame, tokens: str = "tokens", books: int = 4) -> DataFrame:
    """Keep every ``books``-th token of a flattened multi-codebook sequence of matching length."""
    arr = F.col(tokens)
    picked = F.filter(arr, lambda _, i: F.pmod(i, F.lit(books)) == 0)
    return df.withColumn(tokens, F.when((F.size(arr) > 0) & (F.pmod(F.size(arr), F.lit(books)) == 0), picked).otherwise(arr))
