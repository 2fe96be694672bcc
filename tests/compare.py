"""Run registered queries beside their DuckDB twins and say where they differ.

    python tests/compare.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value: object) -> object:
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same rows, else what differs."""
    got_rows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(spark_df.columns) != sorted(want_columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(want_columns)}"
    got, want = rows_of(spark_df.columns, got_rows), rows_of(want_columns, want_rows)
    if got == want:
        return None if got_rows else "no rows"
    extra, lost = list((got - want).items())[:2], list((want - got).items())[:2]
    return f"{len(got_rows)} rows against {len(want_rows)} on {sorted(want_columns)}\n   spark only {extra}\n   duckdb only {lost}"


def main() -> int:
    from tallyspark import catalog
    from tallyspark.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(8), connect(sf_dir)
    oracles, bad = catalog.oracle_sql(), 0
    for name, fn in catalog.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            said = difference(df, con, oracles[name]) if name in oracles else f"rows only: {df.count()}"
        except Exception as exc:  # noqa: BLE001 - the run goes on, the failure is counted
            said = "FAILED " + " ".join(str(exc).split())[:600]
        if said is not None and not said.startswith("rows only"):
            bad += 1
        print(f"{time.time() - start:6.2f}s {name}: {said or 'same'}", flush=True)
    print(f"{bad} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
