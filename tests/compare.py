"""Run registered queries in Spark and their SQL in DuckDB and compare whole results.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as driver  # noqa: E402

DATA = "/root/testdata/sf0.01"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE OR REPLACE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def table(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(name: str, spark, connection, sf_dir: str) -> str:
    """'' when both give the same columns, types of value and rows; else the first difference."""
    frame = driver.queries()[name](spark, sf_dir)
    got = table(frame.columns, [tuple(r) for r in frame.collect()])
    relation = connection.sql(driver.oracle_sql()[name])
    want = table(relation.columns, relation.fetchall())
    if sorted(frame.columns) != sorted(relation.columns):
        return f"columns {sorted(frame.columns)} / {sorted(relation.columns)}"
    types = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    spark_types = {n: types.get(t, t) for n, t in frame.dtypes}
    duck_types = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    if spark_types != duck_types:
        return f"types {spark_types} / {duck_types}"
    if got != want:
        only_got, only_want = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} rows / {len(want)}; only Spark {sorted(only_got, key=repr)[:3]}; only SQL {sorted(only_want, key=repr)[:3]}"
    return ""


if __name__ == "__main__":
    from contactlake.session import build_session

    arguments = sys.argv[1:]
    sf = arguments.pop(0) if arguments and "/" in arguments[0] else DATA
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__log__level="ERROR",
    )
    connection = duck(sf)
    for name in arguments or driver.queries():
        start = time.time()
        try:
            difference = compare(name, spark, connection, sf)
        except Exception as exc:  # report and go on to the next query
            difference = f"error {str(exc)[:600]}"
        print(f"{'ok  ' if not difference else 'DIFF'} {name} {time.time() - start:.1f}s {difference[:900]}", flush=True)
