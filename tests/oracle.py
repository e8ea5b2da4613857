"""Runs registered queries next to their SQL in DuckDB and compares rows.

    python tests/oracle.py [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return repr(0.0 if v == 0 else v) if not math.isnan(v) else "nan"
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str, fn, sql: str | None):
    began = time.time()
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    if sql is None:
        return took, len(got[1]), "rows only"
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return took, len(got[1]), f"COLUMNS {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return took, len(got[1]), f"ROWS {len(got[1])} vs {len(want[1])}: only spark {sorted(a - b)[:2]} only sql {sorted(b - a)[:2]}"
    return took, len(got[1]), "ok"


def main() -> int:
    import __spark_entry__ as entry
    from subvox.session import build_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args[1:] or queries:
        try:
            took, n, verdict = compare(spark, con, folder, name, queries[name], sqls.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            took, n, verdict = 0.0, 0, f"ERROR {str(e)[:600]}"
        bad += verdict not in ("ok", "rows only")
        print(f"{name:32s} {took:7.2f}s {n:8d} {verdict}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
