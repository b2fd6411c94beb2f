"""Single-domain session on a stream of metric batches."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.operators.skew import keyed_join
from hearken.plans.domains import ALREADY_PRESENT, UNKNOWN_NAME, batch_domain, rank_domain

#: (rows of a batch with their ``domain``) to one row per name with its scores, ``rank_utility`` among them.
Scorer = Callable[[DataFrame], DataFrame]
STATE = "name string, domain string, status string, reason string"


class DomainSession:
    """Session state as one folder of changes per committed batch.

    ``process`` is a ``foreachBatch`` function. The rules act on whole batches (a mixed one is
    rejected, one of the other domain starts anew), which a processor keyed by name could not
    see. A batch writes its own rows only, so writes are linear in the input, and then its
    commit: the epoch (the batch that began the present domain) and the domain. The state is
    what the batches of the epoch wrote. A batch reads commits below its own id, so replaying
    it after a failure gives the same rows and nothing is half changed. A rejected batch
    writes none.

    With a ``scorer`` the accepted devices of a batch are scored and ``ranking`` places all
    devices of the session, after any committed batch.
    """

    def __init__(self, spark: SparkSession, path: str, auxiliary: DataFrame, scorer: Scorer | None = None):
        self.spark, self.path, self.scorer = spark, path, scorer
        self._auxiliary = auxiliary

    def _commits(self, before: int | None = None) -> list[tuple[int, int, str | None]]:
        """(batch, epoch, domain) of the committed batches, in order."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS"))]
        ids = sorted(i for i in (int(n.split("=")[1]) for n in done) if before is None or i < before)
        if not ids:
            return []
        # only the last commit is read: it names its epoch
        last = json.loads(self.spark.read.text(f"{self.path}/commits/batch={ids[-1]}").first()["value"])
        return [(i, last["epoch"], last["domain"]) for i in ids if i >= last["epoch"]]

    def _commit(self, rows: DataFrame, batch_id: int, epoch: int, domain: str | None) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id}")
        note = json.dumps({"epoch": epoch, "domain": domain})
        self.spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/commits/batch={batch_id}")

    def changes(self, before: int | None = None) -> DataFrame | None:
        """Rows of the present epoch with their ``batch_id``, as written by its batches below ``before``."""
        ids = [i for i, _, _ in self._commits(before)]
        if not ids:
            return None
        reader = self.spark.read.option("mergeSchema", True).option("basePath", f"{self.path}/changes")
        rows = reader.parquet(*[f"{self.path}/changes/batch={i}" for i in ids])
        return rows.withColumn("batch_id", F.col("batch").cast("long")).drop("batch")

    def snapshot(self, before: int | None = None) -> DataFrame | None:
        """(name, status, reason, batch_id): accepted devices, and the last failure of every name that did not enter later."""
        rows = self.changes(before)
        if rows is None:
            return None
        failed = F.col("status") == "failure"
        per = rows.groupBy("name").agg(
            F.min(F.when(~failed, F.col("batch_id"))).alias("__in"),
            F.max(F.when(failed, F.struct("batch_id", "reason"))).alias("__out"),
        )
        good = per.filter("__in is not null").select("name", F.lit("success").alias("status"), F.lit(None).cast("string").alias("reason"), F.col("__in").alias("batch_id"))
        bad = per.filter("__out is not null and (__in is null or __out.batch_id > __in)").select("name", F.lit("failure").alias("status"), "__out.reason", "__out.batch_id")
        return good.unionByName(bad)

    def current_domain(self) -> str | None:
        commits = self._commits()
        return commits[-1][2] if commits else None

    def replace_auxiliary(self, auxiliary: DataFrame, batch_id: int) -> None:
        """Swap the auxiliary table after it validated; all results are cleared."""
        from hearken.sources.tables import read_auxiliary

        self._auxiliary = read_auxiliary(auxiliary)
        self.clear(batch_id)

    def clear(self, batch_id: int) -> None:
        self._commit(self.spark.createDataFrame([], STATE), batch_id, batch_id, None)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        names = batch.select("name").filter("name IS NOT NULL AND name <> ''").distinct().withColumn("batch_id", F.lit(batch_id))
        info = batch_domain(names, self._auxiliary).first()
        if info is None or info["is_mixed"]:
            return
        commits = self._commits(batch_id)
        domain = commits[-1][2] if commits else None
        switching = info["domain"] is not None and domain is not None and info["domain"] != domain
        epoch = batch_id if switching or not commits else commits[-1][1]
        known = self._auxiliary.select("name", "domain", F.lit(True).alias("__known"))
        rows = keyed_join(names.drop("batch_id"), known, ["name"], "left")
        before = None if switching else self.changes(batch_id)
        if before is None:
            rows = rows.withColumn("__seen", F.lit(None).cast("boolean"))
        else:
            rows = keyed_join(rows, before.filter("status = 'success'").select("name", F.lit(True).alias("__seen")), ["name"], "left")
        reason = F.when(F.col("__seen"), ALREADY_PRESENT).when(F.col("__known").isNull(), UNKNOWN_NAME)
        rows = rows.select("name", "domain", F.when(reason.isNull(), "success").otherwise("failure").alias("status"), reason.alias("reason"))
        if self.scorer is not None:
            accepted = rows.filter("status = 'success'").select("name", "domain")
            rows = keyed_join(rows, self.scorer(keyed_join(batch, accepted, ["name"])), ["name"], "left")
        self._commit(rows, batch_id, epoch, info["domain"] or domain)

    def ranking(self, references: DataFrame, before: int | None = None) -> DataFrame:
        """Rank, percentile and win rate of the session's devices; ``before`` looks back to the state that a batch met."""
        rows = self.changes(before)
        empty = self.spark.createDataFrame([], "name string, domain string, rank_utility double")
        accepted = empty if rows is None or "rank_utility" not in rows.columns else rows.filter("status = 'success'")
        return rank_domain(accepted.select("name", "domain", "rank_utility"), references).filter("not is_reference")
