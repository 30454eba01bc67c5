"""Compare a registered query with its SQL oracle, row by row."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        return float(value)
    value = float(value)
    return "nan" if math.isnan(value) else value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> None:
    frame = query(spark, sf_dir)
    actual = rows_of(frame.columns, frame.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = rows_of(columns, result.fetchall())
    assert sorted(frame.columns) == sorted(columns)
    missing, extra = expected - actual, actual - expected
    assert not missing and not extra, (
        f"{sum(expected.values())} rows expected, {sum(actual.values())} found\n"
        f"columns {sorted(columns)}\nmissing {list(missing.items())[:3]}\nextra {list(extra.items())[:3]}"
    )
    assert actual, "no rows"
