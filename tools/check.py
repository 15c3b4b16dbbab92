"""Runs registered queries beside their SQL in DuckDB and compares every value.

    python tools/check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from verdant import queries as registered  # noqa: E402
from verdant.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def key(row):
    return tuple((v is None, str(type(v)) if not isinstance(v, (int, float, bool)) else "n", v if v is not None else 0) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=key)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--areas", default="")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    if args.areas:
        registered.AREAS = tuple(args.areas.split(","))
    queries, oracles = registered.load()
    folder = f"/root/testdata/sf{args.sf}"
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, fn in queries.items():
        if args.names and name not in args.names:
            continue
        try:
            start = time.time()
            df = fn(spark, folder)
            got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            if name not in oracles:
                print(f"ROWS  {name:38s} {len(got):8d} rows {took:6.2f}s")
                continue
            start = time.time()
            cur = con.execute(oracles[name])
            want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
            sql_took = time.time() - start
            same = got_cols == want_cols and got == want
            bad += not same
            print(f"{'ok   ' if same else 'DIFF '} {name:38s} {len(got):8d} rows {took:6.2f}s sql {sql_took:5.2f}s", flush=True)
            if not same:
                if got_cols != want_cols:
                    print("  columns", sorted(set(got_cols) ^ set(want_cols)))
                print("  rows", len(got), len(want))
                gs, ws = sorted(set(got) - set(want), key=key), sorted(set(want) - set(got), key=key)
                print("  only in spark:", len(gs), " only in sql:", len(ws))
                for g, w in list(zip(gs, ws))[:3]:
                    cells = [(c, x, y) for c, x, y in zip(got_cols, g, w) if x != y or c.endswith("_id")][:8]
                    print("   ", str(cells)[:700])
                if not (gs and ws):
                    for r in (gs or ws)[:3]:
                        print("   ", str(r)[:500])
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {str(exc)[:1500]}")
            if args.names:
                traceback.print_exc()
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
