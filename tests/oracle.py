"""Compare a registered query with its SQL on DuckDB: columns, types and rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "DATE": "date", "BOOLEAN": "boolean", "HUGEINT": "hugeint",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _sorted(rows, columns, order):
    index = [columns.index(c) for c in order]
    picked = [tuple(row[i] for i in index) for row in rows]
    return sorted(picked, key=lambda row: [(v is None, str(v)) for v in row])


def difference(connection, frame, sql: str) -> str | None:
    """None when both agree, else what differs."""
    expected = connection.execute(sql)
    columns = [d[0] for d in expected.description]
    types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in expected.description}
    want = expected.fetchall()
    got_types = dict(frame.dtypes)
    if got_types != types:
        return f"columns or types: spark {got_types}, sql {types}"
    got = [tuple(row) for row in frame.collect()]
    if len(got) != len(want):
        return f"rows: spark {len(got)}, sql {len(want)}"
    order = sorted(columns)
    for a, b in zip(_sorted(got, frame.columns, order), _sorted(want, columns, order), strict=True):
        if a != b and not all(
            x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
            for x, y in zip(a, b, strict=True)
        ):
            return f"values of {order}: spark {a}, sql {b}"
    return None
