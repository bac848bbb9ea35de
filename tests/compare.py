"""Run a registered query on Spark and its SQL on DuckDB, and compare the results."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        con.execute(f"create view {table} as select * from '{path}'")
    return con


def _cell(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def spark_rows(df):
    return sorted(df.columns), _rows(df.columns, df.collect())


def oracle_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return sorted(names), _rows(names, result.fetchall())


def kinds(df):
    simple = {
        "bigint": "integer",
        "int": "integer",
        "double": "number",
        "string": "text",
        "boolean": "boolean",
        "timestamp": "timestamp",
        "timestamp_ntz": "timestamp",
    }
    return {name: simple.get(kind, kind) for name, kind in df.dtypes}


def oracle_kinds(con, sql):
    simple = {
        "BIGINT": "integer",
        "INTEGER": "integer",
        "DOUBLE": "number",
        "VARCHAR": "text",
        "BOOLEAN": "boolean",
        "TIMESTAMP": "timestamp",
    }
    described = con.execute(f"describe {sql}").fetchall()
    return {row[0]: simple.get(row[1], row[1]) for row in described}
