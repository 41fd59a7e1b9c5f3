"""Run the registered queries beside their SQL on DuckDB and compare the rows.

    python -m checks.compare [--sf 0.01] [--cores 8] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(d: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return (0, "")
    if isinstance(x, bool):
        return (1, str(x))
    if isinstance(x, (int, float)):
        return (2, f"{float(x):.9g}")
    return (3, str(x))


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in records)


def compare(con, frame, sql):
    spark_columns, spark_rows = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    sql_columns, sql_rows = rows_of(names, result.fetchall())
    if spark_columns != sql_columns:
        return f"columns differ: {spark_columns} / {sql_columns}"
    if len(spark_rows) != len(sql_rows):
        return f"row counts differ: {len(spark_rows)} / {len(sql_rows)}"
    for a, b in zip(spark_rows, sql_rows):
        if a != b:
            return f"rows differ: {[x[1] for x in a]} / {[x[1] for x in b]}"
    return None


def types(con, frame, sql):
    """Column types that do not correspond, for information."""
    same = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    }
    described = {x[0]: x[1] for x in con.execute("describe " + sql).fetchall()}
    return [
        f"{c}: {t}/{described.get(c)}" for c, t in frame.dtypes if same.get(t, t) != described.get(c)
    ]


def main(argv):
    from checks.catalog import ORACLES, QUERIES
    from riskframe.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--cores", default="8")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args(argv)
    d = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(args.cores), connect(d)
    bad = []
    names = [n for n in QUERIES if not args.names or any(n.startswith(p) for p in args.names)]
    for name in names:
        start = time.time()
        try:
            frame = QUERIES[name](spark, d)
            if name in ORACLES:
                problem = compare(con, frame, ORACLES[name])
                odd = types(con, frame, ORACLES[name])
            else:
                problem, odd = (None if frame.count() > 0 else "no rows"), []
        except Exception as e:  # noqa: BLE001 - the report names the failure
            problem, odd = f"{type(e).__name__}: {str(e)[:600]}", []
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name:32s} {time.time() - start:6.2f}s {'sql' if name in ORACLES else 'rows'} {problem or ''} {odd or ''}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(names) - len(bad)} of {len(names)} ok; failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
