"""Compare queries with their SQL on one data set: python tests/check.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from treeloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def tidy(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(map(tuple, frame.itertuples(index=False)), key=repr)


def differences(spark, db, sf_dir: str, name: str) -> str | None:
    ours = contract.queries()[name](spark, sf_dir).toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return None if len(ours) else "no rows"
    theirs = db.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    for i, (a, b) in enumerate(zip(tidy(ours), tidy(theirs))):
        if a != b:
            return f"row {i}: {a} / {b}"
    return None


if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(contract.queries())
    spark, db = local_session(os.environ.get("BENCH_CPUS", "8")), connection(sf_dir)
    bad = 0
    for name in names:
        begin = time.time()
        try:
            problem = differences(spark, db, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - begin:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
