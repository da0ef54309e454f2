"""Run queries next to their SQL twins: python tests/compare.py sf_dir [names...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, bool):
        return str(v)
    return str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def differences(spark_df, con, sql):
    """Empty if both sides hold the same rows, else a short description."""
    result = con.execute(sql)
    want, want_cols = table_of([c[0] for c in result.description], result.fetchall())
    got, got_cols = table_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}: {got[:2]} / {want[:2]}", len(got)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return (f"{len(bad)} of {len(got)} rows differ, e.g. {bad[:2]}" if bad else ""), len(got)


def main():
    from cohortloom.session import build_session
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sqls:
                diff, n = differences(df, con, sqls[name])
            else:
                diff, n = "", df.count()
        except Exception as e:  # noqa: BLE001
            diff, n = f"{type(e).__name__}: {str(e)[:600]}", 0
        print(f"{'ok  ' if not diff else 'FAIL'} {name} rows={n} {time.time() - start:.1f}s {diff}", flush=True)


if __name__ == "__main__":
    main()
