"""Run registered queries against their SQL twins: ``python -m workload.check``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from workload.oracles import ORACLES
from workload.queries import QUERIES
from workload.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if equal; floats must agree exactly (both sides are rounded)."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    got, want = normal(got), normal(want)
    out = []
    for c in got.columns:
        if got[c].dtype != want[c].dtype:
            out.append(f"{c} is {got[c].dtype} / {want[c].dtype}")
        bad = ~((got[c] == want[c]) | (got[c].isna() & want[c].isna()))
        if bad.any():
            i = bad.idxmax()
            out.append(f"{c}: {bad.sum()} differ, first {got[c][i]!r} / {want[c][i]!r}")
    return "; ".join(out)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main(sf_dir: str, names: list[str]) -> int:
    spark, con, failed = local_session(), duck(sf_dir), 0
    for name in names or list(QUERIES):
        t = time.monotonic()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            took, t = time.monotonic() - t, time.monotonic()
            if name in ORACLES:
                diff = differences(got, con.sql(ORACLES[name]).df())
                status = "FAIL " + diff if diff else "ok"
                status += f" (sql {time.monotonic() - t:.1f}s)"
                failed += bool(diff)
            else:
                status = "rows only" if len(got) else "EMPTY"
        except Exception as e:  # report and go on with the next query
            failed += 1
            took, status = time.monotonic() - t, f"ERROR {type(e).__name__}: {str(e)[:600]}"
            got = []
        print(f"{name:28s} {took:6.1f}s {len(got):8d} rows  {status}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
