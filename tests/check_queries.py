"""Run registered queries next to their check SQL: ``python tests/check_queries.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else round(number, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def duck(sf_dir: str):
    import duckdb

    from corpuslens.sources.bindings import BASE_TABLES

    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, name, sf_dir):
    """(row count, message or '', seconds)."""
    import __spark_entry__ as entry

    begin = time.time()
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    took = time.time() - begin
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), "rows only", took
    con.execute(sql)
    names = [d[0] for d in con.description]
    if sorted(names) != columns:
        return len(got), f"columns {columns} vs {sorted(names)}", took
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in con.fetchall()), key=repr)
    if got == want:
        return len(got), "", took
    if len(got) != len(want):
        message = f"rows {len(got)} vs {len(want)}"
    else:
        message = "values differ"
    only_spark = [r for r in got if r not in set(want)][:3] if len(got) < 50000 else got[:2]
    only_duck = [r for r in want if r not in set(got)][:3] if len(want) < 50000 else want[:2]
    return len(got), f"{message}\n   cols {columns}\n   spark {str(only_spark)[:1500]}\n   duck  {str(only_duck)[:1500]}", took


def main() -> int:
    from corpuslens.session import build_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    names = [n for n in entry.queries() if not args or any(a == n or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    for name in names:
        try:
            rows, message, took = compare(spark, con, name, sf_dir)
        except Exception as exc:  # noqa: BLE001
            rows, message, took = -1, f"ERROR {type(exc).__name__} {str(exc)[:900]}", 0.0
        ok = message in ("", "rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name:40s} rows={rows:<7d} {took:6.2f}s {message}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
