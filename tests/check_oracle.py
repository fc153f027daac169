"""Compare every registered query with its SQL at one scale.

python tests/check_oracle.py [folder] [name …]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (int, str)):
        return repr(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, Decimal):
        return "D" + repr(value)
    if isinstance(value, dt.date):
        return value.isoformat()[:10]
    return repr(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark_df, con, sql):
    mine = spark_df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}", len(mine)
    a, b = rows(spark_df.columns, mine), rows(names, theirs)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}", len(mine)
    off = [(x, y) for x, y in zip(a, b) if x != y]
    if off:
        return f"{len(off)} of {len(a)} rows differ, first {off[0]}", len(mine)
    return None, len(mine)


def main():
    import __spark_entry__ as entry
    from conftest import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("/tmp/tillstar-check-warehouse")
    con = connect(folder)
    oracle, bad = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if args and name not in args:
            continue
        begun = time.time()
        try:
            df = query(spark, folder)
            if name in oracle:
                problem, n = compare(df, con, oracle[name])
                verdict = "ok" if problem is None else f"BAD {problem}"
            else:
                n = len(df.collect())
                verdict = "rows only"
        except Exception as error:  # keep going: this is a report
            n, verdict = -1, f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:32s} {n:7d} rows {time.time() - begun:6.2f}s  {verdict}", flush=True)
        if verdict.startswith(("BAD", "ERROR")):
            bad.append(name)
    print("failed:", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
