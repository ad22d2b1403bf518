"""Run queries and compare them with their SQL in DuckDB: ``check.py [sf] [name-prefix …]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from duoscope.session import TABLES, get_session  # noqa: E402


def normal(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0 if value == value else value
    return value


def compare(df, con, sql):
    """``None`` when equal, else a short reason."""
    got_cols = sorted(df.columns)
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    want = res.fetchall()
    if got_cols != sorted(want_cols):
        return f"columns {got_cols} != {sorted(want_cols)}"
    order = [want_cols.index(c) for c in got_cols]
    want_rows = sorted((tuple(normal(r[i]) for i in order) for r in want), key=repr)
    got_rows = sorted((tuple(normal(v) for v in r) for r in df.select(*got_cols).collect()), key=repr)
    if len(got_rows) != len(want_rows):
        return f"rows {len(got_rows)} != {len(want_rows)}; {got_rows[:2]} / {want_rows[:2]}"
    bad = [(g, w) for g, w in zip(got_rows, want_rows) if g != w or [type(a) for a in g] != [type(a) for a in w]]
    return f"{len(bad)} differ of {len(got_rows)}, first {bad[0]}" if bad else None


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main():
    from duoscope.queries import REGISTRY

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = [n for n in REGISTRY if len(sys.argv) < 3 or any(n.startswith(p) for p in sys.argv[2:])]
    spark = get_session("check", "local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="8g",
                        spark_ui_enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name in names:
        fn, sql = REGISTRY[name]
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            reason = compare(df, con, sql) if sql else (None if df.count() > 0 else "no rows")
        except Exception as e:  # noqa: BLE001
            reason = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{name:24s} {time.time() - start:6.2f}s {'sql' if sql else 'rows'} {'ok' if reason is None else 'FAIL ' + reason}", flush=True)
        if reason:
            failed.append(name)
    print(f"{len(names) - len(failed)} ok, failed: {failed}")
    spark.stop()


if __name__ == "__main__":
    main()
