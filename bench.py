"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from checks import adapters as A  # noqa: E402
from checks import all_queries  # noqa: E402
from checks.training import given_model  # noqa: E402
from hearken.plans.bootstrap import bootstrap_replicates, bootstrap_summary, resampling_modes  # noqa: E402
from hearken.session import local_session, materialise  # noqa: E402


def bootstrap_500(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of one nation's devices with the default 500 replicates (the prediction job's shape: few new devices)."""
    x, model = given_model(spark, sf)
    new = A.load(spark, sf, "supplier").filter("s_nationkey = 7").select(A._dev("s_suppkey").alias("name"))
    some = materialise(x.join(F.broadcast(new), "name", "left_semi"))
    reps = bootstrap_replicates(model, some, 500)
    return bootstrap_summary(reps["overall_replicates"], reps["subdir_replicates"], resampling_modes(some))["overall_summary"]


HEADLINE = (
    "d1_windows_to_x", "d3_x_to_device_subdir", "d6_normalization_stats", "d8_aggregate_uncertainty", "d12_divergence",
    "d16_vector_distances", "d17_frechet", "d18_d22_regression_metrics", "d23_overall_pair_metrics", "c9_e4_f1_f2_neighbours",
    "e5_silence_segments", "c13_f7_estimate_lag", "i1_sliding_windows", "j1_nn_ridge_certificate", "j13_predict_ranking", "j12_train",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()[0]
    runs = {n: registered[n] for n in HEADLINE} | {"j14_bootstrap_500": bootstrap_500}
    spark.read.parquet(f"{sf}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name, fn in runs.items():
        start = time.time()
        fn(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{name}: {took[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
