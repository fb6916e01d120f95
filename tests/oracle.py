"""Run queries on Spark and their SQL on DuckDB and compare whole results.

``python tests/oracle.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Spark type -> DuckDB types taken as the same.
SAME_TYPE = {
    "bigint": {"BIGINT"}, "int": {"INTEGER"}, "smallint": {"SMALLINT"}, "double": {"DOUBLE"},
    "float": {"FLOAT"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}, "date": {"DATE"},
    "timestamp": {"TIMESTAMP"}, "binary": {"BLOB"},
}


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (v if os.environ.get("ORACLE_EXACT") else round(v, 9))
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    return [columns[i] for i in order], out


def compare(df, con, sql: str) -> str | None:
    """None when equal, else the first difference."""
    cur = con.execute(sql)
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want = table_of([d[0] for d in cur.description], cur.fetchall())
    got_types = dict(df.dtypes)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    bad = [f"{c}: {got_types[c]} vs {want_types[c]}" for c in got[0]
           if want_types[c] not in SAME_TYPE.get(got_types[c], set())]
    if bad:
        return "types " + "; ".join(bad)
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"value {a} != {b}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from sievework.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    only = argv[1:]
    spark = local_session("oracle")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sql:
                problem = compare(df, con, sql[name])
                note = "equal" if problem is None else problem
            else:
                problem, note = None, f"rows only: {len(df.collect())}"
        except Exception as exc:  # report and go on with the next query
            problem = note = f"{type(exc).__name__}: {str(exc)[:400]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - start:6.2f}s {note[:420]}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]) > 0)
