"""Compare Spark queries with their SQL on one scale folder: python tests/oracle_check.py [names...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark_df, con, sql):
    """None when equal, else a short description of the first difference."""
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{sum(x != y for x, y in zip(got, want))} rows differ, first {a} vs {b}"
    return None if got else "EMPTY"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from votelens.session import build_session
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = build_session(cpus="8"), connect(sf)
    qs, sql = queries(), oracle_sql()
    wanted = [n for n in qs if not sys.argv[1:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in sys.argv[1:])]
    bad = 0
    for name in wanted:
        t = time.time()
        try:
            df = qs[name](spark, sf)
            if name in sql:
                diff = compare(df, con, sql[name])
            else:
                n = df.count()
                diff = None if n else "EMPTY"
                name += f" [rows only: {n}]"
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print(f"{len(wanted)} queries, {bad} failing")
