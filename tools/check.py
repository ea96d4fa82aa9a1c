"""Compare registered queries with their DuckDB check: python tools/check.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parityspark.plans.fixtures import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, build, sql):
    df = build(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        extra = [x for x in got if x not in set(want)][:2]
        return len(got), f"rows {len(got)} vs {len(want)}; only here {extra}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        return len(got), f"{len(bad)} values differ over {sorted(names)}: {bad[0]}"
    stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {n: (stypes[n], dtypes[n]) for n in stypes if stypes[n] in same and same[stypes[n]] != dtypes[n]}
    return len(got), f"TYPES {odd}" if odd else None


def main():
    from parityspark.session import build_session
    from parityspark.plans import catalog

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = build_session(), connect(sf_dir)
    builds, sqls = catalog.callables(), catalog.oracles()
    failed = 0
    for name, build in builds.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            n, err = compare(spark, con, sf_dir, build, sqls.get(name))
        except Exception as ex:
            n, err = -1, "".join(traceback.format_exception_only(ex))[:1500]
        failed += err is not None
        state = "FAIL" if err else ("ok" if name in sqls else "ok (rows)")
        print(f"{state:10} {name:34} rows={n:<8} {time.time() - t:6.2f}s {err or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
