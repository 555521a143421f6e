"""Run a registered query and its check SQL on one data folder and compare the results."""

import math
import sys
import threading
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, list | tuple):
        return tuple(_norm(x) for x in v)
    try:
        return round(float(v), 6) + 0.0 if type(v).__name__ == "Decimal" else v
    except (TypeError, ValueError):
        return v


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((x is None, str(type(x).__name__ in ("int", "float")), x if x is not None else 0) for x in r)
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    try:
        return sorted(out, key=key)
    except TypeError:
        return sorted(out, key=repr)


def compare(spark, con, folder, fn, sql):
    """Return (problem or None, rows, spark seconds, sql seconds)."""
    t0 = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return (None if got else "no rows"), len(got), t1 - t0, 0.0
    stop = threading.Timer(90, con.interrupt)
    stop.start()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    stop.cancel()
    t2 = time.time()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}", len(got), t1 - t0, t2 - t1
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    off = [f"{c}:{k}/{kinds[c]}" for c, k in df.dtypes if same.get(k, kinds[c]) != kinds[c]]
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}", len(got), t1 - t0, t2 - t1
    a, b = _rows(got, df.columns), _rows(want, cols)
    for x, y in zip(a, b, strict=True):
        if x != y and not all(p == q or (isinstance(p, float) and isinstance(q, float | int) and abs(p - q) < 1.5e-6 * max(1, abs(p)) ) for p, q in zip(x, y, strict=True)):
            return f"{sorted(cols)}: {x} vs {y}", len(got), t1 - t0, t2 - t1
    exact = "" if a == b else " (last digit differs)"
    if off or exact:
        print("   note:", " ".join(off) + exact)
    return None, len(got), t1 - t0, t2 - t1


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from volspark.plans.session import local_session

    folder = "/root/testdata/" + (sys.argv[1] if len(sys.argv) > 1 else "sf0.01")
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            problem, n, s, d = compare(spark, con, folder, fn, entry.oracle_sql().get(name))
        except Exception as e:  # report and go on
            problem, n, s, d = f"{type(e).__name__}: {str(e)[:500]}", -1, 0.0, 0.0
        bad += problem is not None
        print(f"{'OK ' if problem is None else 'BAD'} {name:40s} rows={n} spark={s:.1f}s sql={d:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
