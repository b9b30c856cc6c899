"""Compare registered queries with their SQL on DuckDB: python tools/verify.py [keys or module names]."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lakewright.plans import load_plans  # noqa: E402
from lakewright.sources.tables import TABLES  # noqa: E402


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").appName("verify")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return "-0.0" if v == 0 and math.copysign(1, v) < 0 else v
    if isinstance(v, (dt.datetime, int, str)):
        return v
    return f"UNSAFE<{type(v).__name__}>{v}"


def compatible(ours: str, theirs: str) -> bool:
    """Whether a Spark and a DuckDB column become the same kind of value in pandas."""
    if theirs.startswith("DECIMAL") or theirs.endswith("[]"):
        return False
    return {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"},
            "timestamp_ntz": {"TIMESTAMP"}}.get(ours, set()) >= {theirs}


def compare(spark, folder, key, plan, con):
    begin = time.time()
    df = plan(spark, folder)
    rows = df.collect()
    took = time.time() - begin
    if plan.sql is None:
        return f"rows-only {len(rows)}", took, None
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {plan.sql}").fetchall()}
    mixed = [f"{c}:{k}/{kinds.get(c)}" for c, k in df.dtypes if not compatible(k, kinds.get(c, ""))]
    if mixed:
        return f"TYPES {mixed}", took, False
    cur = con.execute(plan.sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS spark={sorted(df.columns)} sql={sorted(names)}", took, False
    cols = sorted(names)
    si = [df.columns.index(c) for c in cols]
    di = [names.index(c) for c in cols]
    left = sorted((tuple(norm(r[i]) for i in si) for r in rows), key=repr)
    right = sorted((tuple(norm(r[i]) for i in di) for r in want), key=repr)
    for side, data in (("spark", left), ("sql", right)):
        for r in data[:50]:
            for c, v in zip(cols, r):
                if isinstance(v, str) and v.startswith("UNSAFE<"):
                    return f"TYPE {side}.{c}: {v[:60]}", took, False
    if left and right:
        for c, a, b in zip(cols, zip(*left), zip(*right)):
            ta = {type(x) for x in a if x is not None}
            tb = {type(x) for x in b if x is not None}
            if ta != tb:
                return f"TYPE {c}: spark={ta} sql={tb}", took, False
    if left == right:
        note = "" if left else "  (EMPTY)"
        return f"ok {len(left)}{note}", took, True
    only_l = [r for r in left if r not in set(right)][:2]
    only_r = [r for r in right if r not in set(left)][:2]
    return f"DIFF {len(left)}/{len(right)} cols={cols}\n   spark {only_l}\n   sql   {only_r}", took, False


def main(argv):
    folder = "/root/testdata/sf0.01"
    args = []
    for a in argv:
        if a.startswith("sf"):
            folder = f"/root/testdata/{a}"
        elif a != "-v":
            args.append(a)
    plans = load_plans()
    keys = [k for k, p in plans.items()
            if not args or k in args or p.build.__module__.rsplit(".", 1)[-1] in args]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for k in keys:
        try:
            text, took, good = compare(spark, folder, k, plans[k], con)
        except Exception as e:  # noqa: BLE001
            text, took, good = f"ERROR {type(e).__name__}: {str(e)[:700]}", 0.0, False
        bad += good is False
        if good is not True or took > 4 or "EMPTY" in text or "-v" in argv:
            print(f"{k:32s} {took:6.2f}s {text}", flush=True)
    print(f"{len(keys)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main([a for a in sys.argv[1:]]) else 0)
