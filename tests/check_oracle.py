"""Run registered queries next to their SQL and compare names, row counts and values.

``python tests/check_oracle.py [sf_dir] [query ...]``
"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, bool) or value is None:
        return value
    return int(value) if hasattr(value, "__index__") else value


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=repr)


def compare(spark, connection, name, query, sql, sf_dir):
    """An error text, or None when both sides agree."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    if sql is None:
        return None, len(mine)
    cur = connection.execute(sql)
    theirs_columns = [d[0] for d in cur.description]
    if sorted(theirs_columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(theirs_columns)}", len(mine)
    theirs = rows_of(theirs_columns, cur.fetchall())
    if mine == theirs:
        return None, len(mine)
    only = [r for r in mine if r not in set(theirs)][:2], [r for r in theirs if r not in set(mine)][:2]
    return f"{len(mine)} against {len(theirs)} rows; only here {only[0]}; only there {only[1]}", len(mine)


def connect(sf_dir):
    connection = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return connection


if __name__ == "__main__":
    from twinframe.session import build_session
    from workload.queries import QUERIES, SQL

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for query_name in sys.argv[2:] or list(QUERIES):
        started = time.time()
        try:
            error, n = compare(spark, con, query_name, QUERIES[query_name], SQL.get(query_name), folder)
        except Exception as exc:  # report and go on with the next query
            error, n = f"{type(exc).__name__}: {str(exc)[:600]}", -1
        bad += error is not None
        mark = "FAIL" if error else ("ok" if query_name in SQL else "rows")
        print(f"{mark:5}{query_name:32}{n:8} rows {time.time() - started:7.1f}s {error or ''}", flush=True)
    sys.exit(1 if bad else 0)
