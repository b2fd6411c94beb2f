"""Run registered queries next to their SQL twins and compare the rows. ``python -m checks.compare [prefix ...]``"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

from checks import all_queries
from hearken.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if v != v else v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(i) for i in v)
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_plain(v) for v in row) for row in pdf[cols].itertuples(index=False)]
    return sorted(rows, key=repr)


def differences(a: list[tuple], b: list[tuple]) -> str | None:
    if len(a) != len(b):
        return f"row counts {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None


def main() -> int:
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session("compare", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, sql = all_queries()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            got = fn(spark, sf)
            pdf = got.toPandas()
            took = time.time() - start
            if name not in sql:
                print(f"rows  {name} {len(pdf)} rows {took:.1f}s", flush=True)
                continue
            ref = duck.execute(sql[name]).df()
            if sorted(ref.columns) != sorted(pdf.columns):
                problem = f"columns {sorted(pdf.columns)} vs {sorted(ref.columns)}"
            else:
                problem = differences(rows_of(pdf), rows_of(ref))
            kinds = [f"{c}:{pdf[c].dtype}/{ref[c].dtype}" for c in pdf.columns if c in ref.columns and str(pdf[c].dtype) != str(ref[c].dtype)]
            failed += problem is not None
            print(f"{'ok   ' if problem is None else 'FAIL '} {name} {len(pdf)} rows {took:.1f}s {problem or ''} {'types ' + str(kinds) if kinds else ''}", flush=True)
        except Exception as error:
            failed += 1
            where = traceback.extract_tb(error.__traceback__)
            spot = [f"{f.filename.rsplit('/', 1)[-1]}:{f.lineno}" for f in where if "/repo/" in f.filename]
            print(f"ERROR {name} {spot} {str(error)[:700]}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
