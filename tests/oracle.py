"""Comparison of a Spark result with its DuckDB oracle as multisets of rows."""

from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def spark_rows(df: DataFrame) -> tuple[list[str], Counter, dict[str, str]]:
    names = sorted(df.columns)
    types = dict(df.dtypes)
    return names, Counter(tuple(r) for r in df.select(*names).collect()), types


def oracle_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter, dict[str, str]]:
    result = con.execute(sql)
    head = [(d[0], str(d[1])) for d in result.description]
    place = {name: i for i, (name, _) in enumerate(head)}
    names = sorted(place)
    rows = Counter(tuple(r[place[n]] for n in names) for r in result.fetchall())
    return names, rows, dict(head)


# Spark type -> DuckDB type, so that a result does not agree by value only.
SAME_TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None; also checks that the compared types agree."""
    names, rows, types = spark_rows(df)
    other_names, other, other_types = oracle_rows(con, sql)
    if names != other_names:
        return f"columns {names} != {other_names}"
    if rows != other:
        return f"{rows.total()} rows against {other.total()}; only Spark {list((rows - other).items())[:3]}; only oracle {list((other - rows).items())[:3]}"
    unlike = [(n, types[n], other_types[n]) for n in names if SAME_TYPE.get(types[n]) != other_types[n]]
    return f"types {unlike}" if unlike else None
