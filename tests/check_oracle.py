"""Run registered queries against their SQL and report differences: ``check_oracle.py [sf] [name ...]``."""

from __future__ import annotations

import datetime as dt
import math
import pathlib
import sys
import time
from collections import Counter

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return int(v) if isinstance(v, bool) else v


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when both agree, else a short description."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    t = time.time()
    ours = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    t1 = time.time()
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    print(f"    {t1 - t:.1f}s + {time.time() - t1:.1f}s sql", end=" ")
    if ours == theirs:
        return None
    at_fault = sorted({c for a, b in zip(sorted((ours - theirs), key=str), sorted((theirs - ours), key=str)) for c, x, y in zip(cols, a, b) if x != y})
    return f"differ in {at_fault}; rows {sum(ours.values())} vs {sum(theirs.values())}\n   ours   {str(sorted((ours - theirs), key=str)[:2])[:700]}\n   theirs {str(sorted((theirs - ours), key=str)[:2])[:700]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from leadloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    chosen = sys.argv[2:] or list(queries)
    bad = 0
    for name in chosen:
        t = time.time()
        try:
            if name in oracle:
                diff = compare(spark, con, queries[name], oracle[name], folder)
            else:
                diff = None if queries[name](spark, folder).count() >= 0 else "none"
        except Exception as exc:
            diff = f"{type(exc).__name__}: {str(exc)[:500]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} {time.time() - t:.1f}s {'' if name in oracle else '(rows only)'} {diff or ''}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
