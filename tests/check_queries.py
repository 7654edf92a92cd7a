"""Run registered queries next to their SQL twins and report differences.

usage: python tests/check_queries.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from riskloom.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(map(repr, (row[i] for i in order))) for row in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    """(seconds, row count, problem or None)"""
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    if sql is None:
        return seconds, len(got[1]), None
    cur = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return seconds, len(got[1]), f"columns {got[0]} / {want[0]}"
    spark_kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}
    types = {f.name: spark_kinds.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    off = {k: (types[k], kinds[k]) for k in types if types[k] != kinds[k]}
    if got[1] != want[1]:
        only = [r for r in got[1] if r not in set(want[1])][:3], [r for r in want[1] if r not in set(got[1])][:3]
        return seconds, len(got[1]), f"{len(got[1])} / {len(want[1])} rows; spark only {only[0]}; sql only {only[1]}"
    return seconds, len(got[1]), f"types {off}" if off else None


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            seconds, n, problem = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            seconds, n, problem = 0, -1, "".join(traceback.format_exception_only(e))[:900]
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:26} {n:7} rows {seconds:6.2f}s {'' if name in sqls else '(no sql)'} {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
