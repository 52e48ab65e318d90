"""Run a query in Spark and its SQL in DuckDB and tell whether the results are equal."""

import math
from datetime import datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(columns, values):
    """Rows with columns in name order, sorted, each value with its type's name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in values]
    return [columns[i] for i in order], sorted(cells)


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan", ""
    if isinstance(value, datetime):
        return "time", value.isoformat()
    return type(value).__name__, repr(value)


def spark_rows(df):
    return rows(df.columns, df.collect())


def duck_rows(con, sql):
    result = con.execute(sql)
    return rows([c[0] for c in result.description], result.fetchall())
