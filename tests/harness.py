"""Run registered queries on Spark and their checks on DuckDB and compare the results.

Usage: python tests/harness.py [sf] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

from quillmap.registry import ORACLES, QUERIES
from quillmap.registry.base import TABLES


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr
    )


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if name not in ORACLES:
        return False, f"{len(rows)} rows, no check, {took:.1f}s"
    t0 = time.time()
    cur = con.execute(ORACLES[name])
    want_cols, want_kinds = [d[0] for d in cur.description], {d[0]: str(d[1]) for d in cur.description}
    want = table(want_cols, cur.fetchall())
    check_took = time.time() - t0
    got = table(df.columns, rows)
    kinds = {c: k for c, k in df.dtypes}
    names = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{c}: {k} / {want_kinds.get(c)}" for c, k in kinds.items() if names.get(k) != want_kinds.get(c)]
    note = f"{len(rows)} rows, {took:.1f}s, check {check_took:.1f}s" + (f" TYPES {odd}" if odd else "")
    if got == want:
        return True, note
    extra = [r for r in got[1] if r not in set(want[1])][:3] if len(rows) < 200000 else []
    lost = [r for r in want[1] if r not in set(got[1])][:3] if len(rows) < 200000 else []
    return False, f"{note}\n  cols {got[0]} vs {want[0]}\n  rows {len(got[1])} vs {len(want[1])}\n  +{extra}\n  -{lost}"[:1500]


if __name__ == "__main__":
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    names = sys.argv[2:] or sorted(QUERIES)
    spark, con = session(), connect(sf_dir)
    bad = []
    for name in names:
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        print("ok  " if ok else "BAD ", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(len(names) - len(bad), "ok,", len(bad), "bad:", bad)
