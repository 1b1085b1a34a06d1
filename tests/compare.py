"""Run a registered query and its SQL side by side and compare the values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, int):
        return repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got)} ({t1 - t0:.1f}s)", True
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS differ: {sorted(df.columns)} / {sorted(columns)}", False
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        kinds = {type(v).__name__ for r in got[:50] for v in r} - {"str", "int", "float", "bool", "NoneType"}
        return f"ok {len(a)} rows (spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s) {kinds or ''}", True
    sa, sb = set(a), set(b)
    msg = f"VALUES differ: {len(a)} / {len(b)} rows; columns {sorted(columns)}"
    for r in sorted(sa - sb, key=repr)[:3]:
        msg += f"\n   spark {r}"
    for r in sorted(sb - sa, key=repr)[:3]:
        msg += f"\n   sql   {r}"
    return msg, False


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from textward.plans.registry import REGISTRY
    from textward.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name, (fn, sql) in REGISTRY.items():
        if wanted and not any(w in name or w == fn.__module__.rsplit(".", 1)[-1] for w in wanted):
            continue
        try:
            msg, ok = compare(spark, con, name, fn, sql, sf_dir)
        except Exception as exc:  # noqa: BLE001
            msg, ok = f"ERROR {type(exc).__name__}: {str(exc)[:600]}", False
        bad += not ok
        print(f"{name}: {msg}", flush=True)
    print("FAILED" if bad else "ALL OK", bad)
