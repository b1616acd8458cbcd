"""Compare a Spark result with the rows DuckDB returns for the same question."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.date() if value.time() == dt.time() else value
    return value


def rows_by_name(columns, rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def differences(spark_df, connection, sql: str) -> list[str]:
    """Empty if both have the same columns and the same multiset of rows."""
    spark_rows = [tuple(row) for row in spark_df.collect()]
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    expected_rows = cursor.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} instead of {sorted(names)}"]
    got, expected = rows_by_name(spark_df.columns, spark_rows), rows_by_name(names, expected_rows)
    if len(got) != len(expected):
        return [f"{len(got)} rows instead of {len(expected)}"]
    return [f"{a} instead of {b}" for a, b in zip(got, expected) if a != b]
