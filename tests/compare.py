"""Runs registered queries on Spark and on DuckDB and compares the results.

``python -m tests.compare [folder] [name ...]``
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

import __spark_entry__ as contract
from recall.plans import checkpoint

FOLDER = "/root/testdata/sf0.01"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def canonical(rows: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, in a fixed order, numbers and times made comparable."""
    rows = rows[sorted(rows.columns)].copy()

    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, pd.Timestamp):
            return v.to_pydatetime().replace(tzinfo=None)
        return v.item() if hasattr(v, "item") else v

    out = [tuple(plain(v) for v in r) for r in rows.itertuples(index=False)]
    return sorted(out, key=repr)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    a, b = canonical(ours), canonical(theirs)
    if a == b:
        return None
    only_a, only_b = set(map(repr, a)) - set(map(repr, b)), set(map(repr, b)) - set(map(repr, a))
    return f"rows {len(a)} and {len(b)}; only ours {sorted(only_a)[:2]}; only theirs {sorted(only_b)[:2]}"


def main() -> int:
    from tests.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else FOLDER
    names = args or list(contract.queries())
    spark, db = local_session(), connect(folder)
    bad = 0
    for name in names:
        started = time.time()
        try:
            ours = contract.queries()[name](spark, folder).toPandas()
            took = time.time() - started
            sql = contract.oracle_sql().get(name)
            problem = difference(ours, db.sql(sql).df()) if sql else None
            state = f"DIFFERS {problem}" if problem else ("ok" if sql else "no sql")
        except Exception as e:  # report and go on with the next query
            took, state = time.time() - started, f"FAILED {type(e).__name__} {str(e)[:600]}"
            ours = pd.DataFrame()
        checkpoint.clear(spark)
        bad += state.startswith(("DIFFERS", "FAILED"))
        print(f"{name:28} {took:6.2f}s {len(ours):7} rows  {state}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
