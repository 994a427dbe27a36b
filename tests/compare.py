"""Run a query and its DuckDB statement and compare rows, order aside."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = ("customer", "orders", "events")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(r) for r in df.select(*names).collect())


def duck_rows(con, sql: str) -> tuple[list[str], Counter]:
    names = sorted(c[0] for c in con.execute(f"DESCRIBE {sql}").fetchall())
    listed = ", ".join(f'"{n}"' for n in names)
    return names, Counter(con.execute(f"SELECT {listed} FROM ({sql})").fetchall())


SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def spark_types(df) -> dict[str, str]:
    return {
        f.name: SAME_TYPE.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
        for f in df.schema
    }


def duck_types(con, sql: str) -> dict[str, str]:
    return {c[0]: c[1] for c in con.execute(f"DESCRIBE {sql}").fetchall()}
