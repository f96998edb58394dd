"""Local twin of the driver's correctness gate: run a registered query on Spark and
its oracle SQL on DuckDB over the same Parquet files, then compare row count,
column names and an order-insensitive digest of the values.

Usage: ``python -m citeweave.plans.oracle_check [sf_dir] [name ...]``
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con.execute(sql).fetchdf()


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, int):
        return str(v)
    try:
        import pandas as pd

        if v is pd.NA or v is pd.NaT:
            return "∅"
    except Exception:
        pass
    return str(v)


def digest(pdf) -> tuple[int, list[str], str]:
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows.append("|".join(_norm(x.item() if hasattr(x, "item") and not hasattr(x, "tolist") else x) for x in rec))
    rows.sort()
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(rows), cols, h


def diff_rows(a, b, limit=5):
    cols = sorted(a.columns)
    ra = sorted("|".join(_norm(x) for x in r) for r in a[cols].itertuples(index=False, name=None))
    rb = sorted("|".join(_norm(x) for x in r) for r in b[cols].itertuples(index=False, name=None))
    sa, sb = set(ra), set(rb)
    return [r for r in ra if r not in sb][:limit], [r for r in rb if r not in sa][:limit]


def check(spark, name: str, sf_dir: str, verbose: bool = True) -> dict:
    from citeweave.plans.registry import load_all

    q = load_all()[name]
    t0 = time.time()
    sdf = q.fn(spark, sf_dir).toPandas()
    t1 = time.time()
    out = {"name": name, "spark_rows": len(sdf), "spark_sec": round(t1 - t0, 2)}
    if q.sql is None:
        out["status"] = "rows-only"
        return out
    ddf = duck(q.sql, sf_dir)
    out["duck_sec"] = round(time.time() - t1, 2)
    ns, cs, hs = digest(sdf)
    nd, cd, hd = digest(ddf)
    out.update(duck_rows=nd, cols_match=cs == cd, hash_match=hs == hd)
    out["status"] = "ok" if (ns == nd and cs == cd and hs == hd) else "MISMATCH"
    if out["status"] != "ok" and verbose:
        out["spark_cols"], out["duck_cols"] = cs, cd
        if cs == cd:
            out["only_spark"], out["only_duck"] = diff_rows(sdf, ddf)
    return out


def main(argv: list[str]) -> int:
    from citeweave.plans.registry import load_all
    from citeweave.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or sorted(load_all())
    spark = local_session(8)
    bad = 0
    for n in names:
        try:
            r = check(spark, n, sf_dir)
        except Exception as exc:  # report and continue
            r = {"name": n, "status": "ERROR", "error": repr(exc)[:800]}
        bad += r["status"] not in ("ok", "rows-only")
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
