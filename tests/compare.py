"""Run catalog queries on Spark and on DuckDB and compare the results as multisets.

Usage: python -m tests.compare [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, int):
        return repr(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is not None, str(x)) for x in t)
    )


def compare(spark, con, fn, sql, sf_dir: str = SF_DIR) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return True, f"rows={len(got_rows)} (no oracle)"
    rel = con.execute(sql)
    want_names = [d[0] for d in rel.description]
    want_rows = rel.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return False, f"columns {sorted(df.columns)} != {sorted(want_names)}"
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    duck_kinds = {d[0]: str(d[1]) for d in rel.description}
    for n in kinds:
        a, b = kinds[n], duck_kinds[n].upper()
        if (a == "double") != (b == "DOUBLE") or "DECIMAL" in b or "HUGEINT" in b or a == "decimal":
            return False, f"type of {n}: spark {a} duckdb {b}"
    got, want = rows_of(df.columns, got_rows), rows_of(want_names, want_rows)
    if got == want:
        return True, f"rows={len(got)}"
    diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
    return False, f"rows {len(got)} vs {len(want)}; cols={sorted(df.columns)}\n   first diffs: {diff}"


def main(names):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from brightlake.session import local_session

    spark = local_session()
    con = duck()
    fns, sqls = entry.queries(), entry.oracle_sql()
    picked = [n for n in fns if not names or any(n.startswith(p) for p in names)]
    bad = []
    for n in picked:
        t0 = time.time()
        try:
            ok, note = compare(spark, con, fns[n], sqls.get(n))
        except Exception as e:  # report and go on to the next query
            text = str(e)
            roots = [line.strip() for line in text.splitlines() if "Caused by" in line or "Exception:" in line or "Suppressed" in line]
            ok, note = False, f"{type(e).__name__}: {text[:500]} ... {roots[:6]}"
        print(f"{'ok  ' if ok else 'FAIL'} {n:40s} {time.time() - t0:6.2f}s {note}", flush=True)
        if not ok:
            bad.append(n)
    print(f"{len(picked) - len(bad)}/{len(picked)} ok; failed: {bad}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
