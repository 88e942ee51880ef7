"""Run registered queries beside their check SQL: python tests/oracle_check.py [sf] [name part ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{base}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, (datetime, date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, base):
    start = time.time()
    df = fn(spark, base)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    odd = {k: v for k, v in types.items() if v.startswith(("decimal", "timestamp", "array", "map", "struct", "date"))}
    if sql is None:
        return True, len(got[1]), took, f"rows only {odd or ''}"
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, len(got[1]), took, f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:3] if len(got[1]) < 50000 else "many"
        missing = [r for r in want[1] if r not in set(got[1])][:3] if len(got[1]) < 50000 else "many"
        return False, len(got[1]), took, f"{len(got[1])} vs {len(want[1])} rows\n   spark {extra}\n   duck  {missing}"
    return True, len(got[1]), took, f"{odd or ''}"


def main():
    import __spark_entry__ as entry
    from tidemark.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    base = f"/root/testdata/sf{sf}"
    con = duck(base)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            ok, n, took, note = compare(spark, con, name, fn, oracles.get(name), base)
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, n, took, note = False, -1, 0.0, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(f"\n{'ok  ' if ok else 'FAIL'} {name:45s} rows={n:<7d} {took:6.2f}s {note}", flush=True)
    print(f"{bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
