"""Runs queries on Spark and their SQL on DuckDB and reports differences.

    python -m checks.compare [sf folder] [query name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 9) + 0.0)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def expected(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = [str(d[1]) for d in cur.description]
    rows = cur.fetchall()
    con.close()
    return names, kinds, rows


def ordered(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, fn, sql: str | None):
    """(rows, seconds, problem); no problem is an empty string."""
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - t
    if sql is None:
        return len(got), seconds, ""
    names, kinds, want = expected(sf_dir, sql)
    gn, g = ordered(df.columns, got)
    wn, w = ordered(names, want)
    if gn != wn:
        return len(got), seconds, f"columns {gn} <> {wn}"
    if g == w:
        return len(got), seconds, ""
    only_g = [x for x in g if x not in set(w)][:2]
    only_w = [x for x in w if x not in set(g)][:2]
    return len(got), seconds, f"{len(g)} rows against {len(w)}\n  spark {only_g}\n  sql   {only_w}\n  {gn}"


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from checks import load
    from orelode.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    queries, sql = load()
    chosen = argv[1:] or list(queries)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in chosen:
        try:
            n, seconds, problem = compare(spark, sf_dir, queries[name], sql.get(name))
        except Exception as exc:  # reported per query, the rest still run
            n, seconds, problem = 0, 0.0, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(problem)
        mark = "FAIL" if problem else ("ok" if name in sql else "ok (rows only)")
        print(f"{name:28s} {n:7d} rows {seconds:6.2f}s {mark} {problem}", flush=True)
    print("failed:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
