"""Runs registered queries next to their SQL in DuckDB and compares the values.

Command line: ``python -m tests.oracle [sf_dir] [name-prefix ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
import sys
import time

import duckdb

os.environ.setdefault("PYTHONHASHSEED", "0")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, float):
        return "nan" if value != value else repr(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return f"DEC:{value}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(norm(v) for v in value) + "]"
    return repr(value)


def normalise(columns: list[str], rows) -> list[tuple]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in at) for r in rows)


def compare(spark, sf_dir: str, fn, sql: str | None, con=None) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    rows = df.collect()
    if sql is None:
        return False, f"rows={len(rows)}, no SQL to compare with"
    con = con or connect(sf_dir)
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    expected = cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    a, b = normalise(df.columns, rows), normalise(columns, expected)
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return False, f"{len(bad)} of {len(a)} rows differ, first: {bad[0]}"
    return True, f"rows={len(a)}"


def main() -> int:
    from prefmine.core import get_session
    from prefmine.queries import load

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    queries, oracles = load()
    spark = get_session("oracle", "8")
    con = connect(sf_dir)
    failed, total = [], time.time()
    for name, fn in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, sf_dir, fn, oracles.get(name), con)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {note}", flush=True)
    print(f"{len(failed)} failed: {failed}; {time.time() - total:.0f}s")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
