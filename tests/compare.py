"""Compare registered queries with their SQL in DuckDB: python tests/compare.py [directory] [name ...]"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def engine(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{directory}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, Decimal)):
        return ("n", round(float(value), 6) + 0.0)
    if isinstance(value, int):
        return ("n", float(value)) if abs(value) < 2**53 else value
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return str(value)


def bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a Spark result and a SQL result; empty when nothing does."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    ours, theirs = bag(df.columns, df.collect()), bag(names, result.fetchall())
    if ours == theirs:
        return []
    found = [f"rows {sum(ours.values())} vs {sum(theirs.values())}, columns {sorted(names)}"]
    found += [f"  spark only: {row}" for row in list((ours - theirs))[:3]]
    found += [f"  sql only:   {row}" for row in list((theirs - ours))[:3]]
    return found


def main(directory: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry
    from lanewise.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = engine(directory)
    queries, statements = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in wanted or queries:
        start = time.time()
        try:
            df = queries[name](spark, directory)
            found = differences(df, con, statements[name]) if name in statements else [f"no SQL; {df.count()} rows"]
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:900]}"]
        bad += bool(found)
        print(f"{'DIFF' if found else 'ok  '} {name} {time.time() - start:.1f}s", flush=True)
        for line in found:
            print("    ", line, flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    where = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.001"
    sys.exit(bool(main(where, args)))
