"""Session and checkpoint-folder helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders written by ``materialise`` in each open ``temporary_tables`` scope.
_scopes: list[list[str]] = []


def local_session(app: str = "hearken", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for cut lineage: ``spark.checkpoint.dir``, else a folder in the warehouse, which executors share too."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current is None:
        current = f"{spark.conf.get('spark.sql.warehouse.dir')}/steps"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet in the shared checkpoint folder and read it back.

    Used where one result feeds several jobs (fold lattice, iterative fits). A
    written table survives executor loss and, unlike a cached frame, carries no lineage.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the tables that ``materialise`` writes inside, at the end.

    For whole jobs: frames that were made inside and not written elsewhere are gone then.
    """
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for path in _scopes.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
