"""Compare registered queries with their SQL: ``python tests/oracle.py [name-prefix ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF_DIR):
    from proofline.plans.base import TABLES
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return ("nan",)
    return (value is None, type(value).__name__, str(value)) if value is not None else (True, "", "")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir: str = SF_DIR) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return True, f"{len(got)} rows, no SQL"
    cur = con.execute(sql)
    columns, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    left, right = rows_of(df.columns, got), rows_of(columns, want)
    if left == right:
        return True, f"{len(left)} rows"
    extra = [r for r in left if r not in set(right)][:2]
    missing = [r for r in right if r not in set(left)][:2]
    return False, f"{len(left)} rows != {len(right)}; only spark {extra}; only sql {missing}"


def main(prefixes: list[str]) -> int:
    from proofline import session
    import __spark_entry__ as registry
    spark = session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                          "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(), 0
    for name, fn in registry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, name, fn, registry.oracle_sql().get(name))
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name:36s} {time.time() - start:6.2f}s  {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
