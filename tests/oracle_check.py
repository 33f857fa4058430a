"""Compare every query with its SQL at one scale: python tests/oracle_check.py DIR [names]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_rows(folder: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    cursor = con.execute(sql)
    types = {c[0]: str(c[1]) for c in cursor.description}
    return types, cursor.fetchall()


# What DuckDB calls the Spark types used in the results.
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}


def same(spark, folder: str, name: str) -> tuple[bool, str]:
    """Row-for-row equality after sorting columns by name and rows by value."""
    start = time.time()
    df = entry.queries()[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in entry.oracle_sql():
        return bool(rows), f"{len(rows)} rows (no SQL) {took:.1f}s"
    start = time.time()
    types, expected = oracle_rows(folder, entry.oracle_sql()[name])
    names = list(types)
    sql_took = time.time() - start
    wanted = {c: SQL_TYPES[t] for c, t in df.dtypes}
    if wanted != types:
        return False, f"schema {wanted} != {types}"
    order_a = sorted(range(len(names)), key=lambda i: df.columns[i])
    order_b = sorted(range(len(names)), key=lambda i: names[i])
    a = sorted((tuple(r[i] for i in order_a) for r in rows), key=repr)
    b = sorted((tuple(r[i] for i in order_b) for r in expected), key=repr)
    differing = [(x, y) for x, y in zip(a, b) if x != y]
    detail = f"{len(a)}/{len(b)} rows {took:.1f}s sql {sql_took:.1f}s"
    if a != b:
        detail += f" first difference: {str(differing[:1])[:600]}"
    return a == b, detail


if __name__ == "__main__":
    from tidemark.session import get_spark

    spark = get_spark(
        "oracle-check", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8"
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or entry.queries():
        try:
            ok, detail = same(spark, sys.argv[1], name)
        except Exception as exc:
            ok, detail = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        print("ok  " if ok else "FAIL", name, detail, flush=True)
