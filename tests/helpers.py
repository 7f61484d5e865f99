"""Comparing Spark results with DuckDB's."""

from __future__ import annotations

import datetime
import math
import os

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)
SF = "/root/testdata/sf0.001"
HAVE_DATA = os.path.isdir(SF)


def plain(value):
    """A value by which both engines' results compare."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else f"{value:.9g}"
    if isinstance(value, datetime.datetime):
        return str(value)[:19]
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def agrees(spark, query, sql: str, sf_dir: str = SF) -> None:
    df = query(spark, sf_dir)
    result = duck(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(result.columns)
    assert table_of(df.columns, df.collect()) == table_of(result.columns, result.fetchall())
