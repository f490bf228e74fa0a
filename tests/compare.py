"""Run registered queries against their comparison SQL in DuckDB and report differences."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connection(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(df, con, sql: str) -> list[str]:
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    from decimal import Decimal

    odd = {c for t in want for c, v in zip(want_cols, t) if isinstance(v, Decimal)}
    if odd:
        return [f"decimal columns {odd}"]
    if got_cols != want_cols:
        return [f"columns {set(got_cols) ^ set(want_cols)}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    bad = []
    if got == want:
        return bad
    # align on the non-float columns, so one differing value does not shift the rest
    fixed = [i for i, c in enumerate(got_cols) if not any(isinstance(r[i], float) for r in (*got[:200], *want[:200]))]
    key = lambda t: tuple((t[i] is None, str(t[i])) for i in fixed)
    got, want = sorted(got, key=key), sorted(want, key=key)
    per_col: dict[str, list] = {}
    for a, b in zip(got, want):
        for c, x, y in zip(got_cols, a, b):
            if x != y:
                per_col.setdefault(c, []).append((x, y))
    return [f"{c}: {len(v)} differ, e.g. {v[0]} {v[len(v) // 2]}" for c, v in per_col.items()]


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from marketspark.session import get_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8"})
    con = connection(sf)
    failed = []
    for name, fn in entry.queries().items():
        if argv and not any(a in name for a in argv):
            continue
        t0 = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            df = fn(spark, sf)
            if sql is None:
                n = df.count()
                print(f"ROWS {name} {n} {time.time() - t0:.1f}s", flush=True)
                continue
            t1 = time.time()
            bad = compare(df, con, sql)
        except Exception as e:  # noqa: BLE001
            bad = [str(e)[:1500]]
            t1 = t0
        print(("ok  " if not bad else "BAD ") + f"{name} {time.time() - t1:.1f}s", *bad, sep="\n     " if bad else "", flush=True)
        if bad:
            failed.append(name)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(bool(main(sys.argv[1:])))
