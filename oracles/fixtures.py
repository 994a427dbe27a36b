"""Derived tables as DuckDB common table expressions."""

from __future__ import annotations

import re

from tenure.model import SCHEMAS
from tenure.sources.derived import Recipe, recipes

_BOOK = recipes("timestamp")
_SQL_TYPES = {
    "bigint": "bigint",
    "int": "integer",
    "string": "varchar",
    "boolean": "boolean",
    "timestamp_ntz": "timestamp",
}


def _select(recipe: Recipe, name: str) -> str:
    types = {}
    if name in SCHEMAS:
        types = {f.name: _SQL_TYPES[f.dataType.simpleString()] for f in SCHEMAS[name]}
    columns = ", ".join(
        f"cast({sql} as {types[col]}) AS {col}" if col in types else f"{sql} AS {col}"
        for col, sql in recipe.columns.items()
    )
    where = f" WHERE {recipe.where}" if recipe.where else ""
    if not recipe.pick:
        return f"SELECT {columns} FROM {recipe.source}{where}"
    pick = recipe.pick
    direction = "DESC" if pick.newest else "ASC"
    order = ", ".join(f"{c} {direction}" for c in pick.order)
    keep = ", ".join((f"{pick.key_sql} AS {pick.key}", *recipe.keep))
    best = (
        f"SELECT {keep} FROM {recipe.source}{where} "
        f"QUALIFY row_number() OVER (PARTITION BY {pick.key_sql} ORDER BY {order}) = 1"
    )
    return f"SELECT {columns} FROM ({best}) AS best"


def with_fixtures(sql: str, shared: dict[str, str]) -> str:
    """Prefix ``sql`` with the definitions of every table it names.

    ``shared`` holds further named queries that statements may use.
    """
    bodies = {
        **{n: " UNION ALL ".join(_select(r, n) for r in rs) for n, rs in _BOOK.items()},
        **shared,
    }
    order: list[str] = []

    def visit(text: str) -> None:
        for name in bodies:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(bodies[name])
                order.append(name)

    visit(sql)
    ctes = ",\n".join(f"{n} AS ({bodies[n]})" for n in order)
    return f"WITH {ctes}\n{sql}" if ctes else sql
