"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; the warehouse where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/steps"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage, so a lost executor costs one task and not the whole history,
    and lets several jobs read one result.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _scopes[-1:]:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders written by ``stored`` in each open ``stored_alone`` scope.
_scopes: list[list[str]] = []


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], instead_of: str | None = None) -> tuple[DataFrame, str]:
    """The stored result of ``make`` and its folder; what was stored on the way there, and the table ``instead_of``, is deleted.

    For steps that follow each other: each reads only the table of the one before.
    """
    _scopes.append([])
    try:
        out = stored(make())
    finally:
        made = _scopes.pop()
    for path in [*made[:-1], *([instead_of] if instead_of else [])]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out, made[-1]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, everything else as it is; null stays null."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(ident: Column, text: Column) -> list[Column]:
    """Two longs naming a document: its id (0 if null) and a fingerprint of id and text.

    Rows with the same id and text share the key; such rows always get the same result.
    """
    return [F.coalesce(ident.cast("long"), F.lit(0)).alias("k_id"), F.xxhash64(ident.isNull(), text).alias("k_fp")]


#: Keys that hold more than this part of all rows are hot; there can be no more of them than its inverse.
HOT_SHARE = 1 / 2000


def join_hot(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key and the key's number of rows as ``n``.

    The table's rows of hot keys, 2,000 at most, are broadcast, so such a key stays spread
    over the tasks that hold its rows; all other keys are shuffled. ``total`` is the number of rows.
    """
    hot = table.filter(F.col("n") > F.lit(total * HOT_SHARE)).drop("n")
    cold = table.filter(F.col("n") <= F.lit(total * HOT_SHARE)).drop("n")
    spread = rows.join(F.broadcast(hot), key)
    return spread.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))
