"""Run queries on Spark and their SQL in DuckDB over the same files and compare all values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def canonical_rows(columns, rows):
    """Rows as sorted tuples of texts, columns in order of their names."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_canonical(row[i]) for i in order) for row in rows)


_TYPES = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "date": "DATE",
          "boolean": "BOOLEAN"}


def differences(df, connection, sql: str) -> list[str]:
    """What differs between a Spark result and a SQL result, empty when nothing does."""
    problems = []
    types = {row[0]: row[1] for row in connection.execute(f"DESCRIBE {sql}").fetchall()}
    for name, kind in df.dtypes:
        if types.get(name) != _TYPES.get(kind):
            problems.append(f"type of {name} is {kind} expected {types.get(name)}")
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = canonical_rows(names, cursor.fetchall())
    actual = canonical_rows(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} expected {sorted(names)}")
    if len(actual) != len(expected):
        problems.append(f"{len(actual)} rows expected {len(expected)}")
    for got, wanted in zip(actual, expected):
        if got != wanted:
            problems.append(f"row {got} expected {wanted}")
            break
    return problems
