"""Runs registered queries next to their DuckDB statements: ``python -m tests.oracle [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def sf_dir(sf: str = "0.001") -> str:
    return f"/root/testdata/sf{sf}"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return f"{type(v).__name__}:{v}"


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when both sides have the same columns and the same bag of rows."""
    rows = spark_df.collect()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    order = sorted(names)
    at = [names.index(n) for n in order]
    left = sorted(tuple(cell(r[n]) for n in order) for r in rows)
    right = sorted(tuple(cell(r[i]) for i in at) for r in want)
    if left == right:
        return []
    out = [f"rows {len(left)} != {len(right)}"] if len(left) != len(right) else []
    only_l, only_r = sorted(set(left) - set(right)), sorted(set(right) - set(left))
    out.append(f"{len(only_l)} rows only in Spark, {len(only_r)} only in SQL; columns {order}")
    out += [f"  spark {str(x)[:600]}" for x in only_l[:2]] + [f"  sql   {str(x)[:600]}" for x in only_r[:2]]
    return out


def main(argv: list[str]) -> int:
    import __spark_entry__ as e
    from textloom.session import local_session

    sf = argv[0] if argv else "0.001"
    names = argv[1:] or list(e.queries())
    names = [n for n in e.queries() if any(n.startswith(p) for p in names)]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir(sf)), []
    for n in names:
        start = time.time()
        try:
            df = e.queries()[n](spark, sf_dir(sf))
            sql = e.oracle_sql().get(n)
            if sql is None:
                status = f"rows {df.count()} (no SQL)"
            else:
                diff = differences(df, con, sql)
                status = "ok" if not diff else "\n    ".join(["DIFF", *diff])
                if diff:
                    bad.append(n)
        except Exception as x:  # report and go on with the next query
            bad.append(n)
            status = "ERROR " + "".join(traceback.format_exception_only(x))[:1200]
        print(f"{n:40s} {time.time() - start:6.1f}s  {status}", flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} ok; failing: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
