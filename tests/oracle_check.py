"""Run Spark queries next to their DuckDB oracle SQL and compare
(row count, column names, order-insensitive values).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import contextlib
import io
import math
import sys
import time
from collections import Counter

import duckdb


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    from emberline.plans.tables import TABLES
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir: str, name: str) -> dict:
    import __spark_entry__ as entry

    q = entry.queries()[name]
    sql = entry.oracle_sql().get(name)
    t0 = time.time()
    sdf = q(spark, sf_dir)
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        sdf.explain("formatted")
    spdf = sdf.toPandas()
    t_spark = time.time() - t0
    res = {"name": name, "spark_rows": len(spdf), "spark_sec": round(t_spark, 2), "_plan": plan.getvalue()}
    if sql is None:
        res["status"] = "rows-only"
        return res
    t0 = time.time()
    dres = con.execute(sql)
    dcols = [d[0] for d in dres.description]
    drows = dres.fetchall()
    res["duck_sec"] = round(time.time() - t0, 2)
    res["duck_rows"] = len(drows)
    scols = list(spdf.columns)
    if sorted(scols) != sorted(dcols):
        res["status"] = f"COLUMNS spark={scols} duck={dcols}"
        return res
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    srows = Counter(tuple(_norm(r[i]) for i in si) for r in spdf.itertuples(index=False, name=None))
    drows_c = Counter(tuple(_norm(r[i]) for i in di) for r in drows)
    if srows == drows_c:
        res["status"] = "MATCH"
    else:
        only_s = list((srows - drows_c).elements())[:3]
        only_d = list((drows_c - srows).elements())[:3]
        res["status"] = "VALUES"
        res["only_spark"] = [str(x)[:300] for x in only_s]
        res["only_duck"] = [str(x)[:300] for x in only_d]
    return res


def main(argv):
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from emberline.session import build_session
    import __spark_entry__ as entry

    spark = build_session()
    con = duck(sf_dir)
    names = argv[2:] or list(entry.queries())
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, sf_dir, n)
        except Exception as e:  # report and go on
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("MATCH", "rows-only"):
            bad += 1
        r.pop("_plan", None)
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
