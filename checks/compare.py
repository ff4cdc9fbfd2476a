"""Run registered queries in Spark and DuckDB and compare all rows exactly."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.oracle_queries import ORACLE
from checks.queries import QUERIES
from tidefold.session import local_session

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((v is None, str(v)) for v in row),
    )


def connect(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def compare(spark, connection, name: str, sf_dir: str) -> str:
    """Empty if both engines agree, else what differs."""
    frame = QUERIES[name](spark, sf_dir)
    ours = frame.collect()
    cursor = connection.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(set(columns) ^ set(frame.columns))}"
    a, b = _rows(ours, frame.columns), _rows(theirs, columns)
    if len(a) != len(b):
        return f"rows {len(a)} and {len(b)}"
    if not a:
        return "no rows"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        names = sorted(columns)
        x, y = wrong[0]
        return f"{len(wrong)} of {len(a)} rows, first " + str(
            [(n, p, q) for n, p, q in zip(names, x, y) if p != q][:6]
        )
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    spark, connection = local_session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names or QUERIES:
        started = time.time()
        try:
            found = compare(spark, connection, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(found)
        print(f"{name}: {found or 'ok'} ({time.time() - started:.1f} s)", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
