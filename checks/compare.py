"""Run queries in Spark and their SQL in DuckDB and compare all values.

    python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracle import SQL
from checks.spark_queries import QUERIES
from eventloom.session import configure

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _sortable(row: tuple) -> tuple:
    return tuple((value is None, str(type(value)), value if value is not None else 0) for value in row)


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def difference(result: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None where names, types and all rows are equal, else what differs first."""
    answer = connection.execute(sql)
    theirs = [d[0] for d in answer.description]
    ours = result.columns
    if sorted(ours) != sorted(theirs):
        return f"columns {sorted(ours)} != {sorted(theirs)}"
    names = sorted(ours)
    ours_rows = sorted((tuple(_plain(row[n]) for n in names) for row in result.collect()), key=_sortable)
    places = [theirs.index(n) for n in names]
    theirs_rows = sorted((tuple(_plain(row[p]) for p in places) for row in answer.fetchall()), key=_sortable)
    if len(ours_rows) != len(theirs_rows):
        return f"{len(ours_rows)} rows != {len(theirs_rows)}"
    for a, b in zip(ours_rows, theirs_rows):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{dict(zip(names, a))} != {dict(zip(names, b))}"
    return None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    spark = configure(builder.config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            result = QUERIES[name](spark, folder)
            found = difference(result, connection, SQL[name]) if name in SQL else f"no sql, {result.count()} rows"
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{name}: {found or 'equal'} ({time.time() - start:.1f}s)", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} equal; without sql: {sorted(set(QUERIES) - set(SQL))}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
