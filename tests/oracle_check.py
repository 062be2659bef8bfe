"""Run registered queries next to their SQL checks and compare every value."""
from __future__ import annotations

import math
import sys
import time

import duckdb

from callscope.plans.fixtures import BASE


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads=4")
    for b in BASE:
        con.execute(f"CREATE VIEW {b} AS SELECT * FROM '{sf_dir}/{b}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if type(v).__name__ == "Decimal":
        return ("DECIMAL", str(v))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [cols[i] for i in order]


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got, gc = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if sql is None:
        return "rows", f"{len(got)} rows", took
    t0 = time.time()
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want, wc = rows_of(cols, rel.fetchall())
    duck = time.time() - t0
    if gc != wc:
        return "BAD", f"columns {gc} vs {wc}", took
    if len(got) != len(want):
        return "BAD", f"{len(got)} rows vs {len(want)}", took
    for g, w in zip(got, want):
        if repr(g) != repr(w):
            diff = [(c, a, b) for c, a, b in zip(gc, g, w) if repr(a) != repr(b)]
            return "BAD", f"row {str(g)[:300]}: {str(diff)[:600]}", took
    return "ok", f"{len(got)} rows, duck {duck:.1f}s", took


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from callscope.session import build_session
    sf_dir, *wanted = argv
    spark = build_session(**{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    con = connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in qs:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            state, note, took = compare(spark, con, sf_dir, name, qs[name], sqls.get(name))
        except Exception as exc:  # a failing query must not hide the others
            state, note, took = "ERR", str(exc)[:900].replace("\n", " "), 0.0
        bad += state in ("BAD", "ERR")
        print(f"@@ {state:4} {name:34} {took:6.1f}s {note}", flush=True)
    print(f"@@ done, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
