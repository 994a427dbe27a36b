"""Text and JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID_WIDTH = 256


def spaced_once(value: Column) -> Column:
    """Replace only the first underscore by a space."""
    return F.regexp_replace(value, "^([^_]*)_", "$1 ")


def label(value: Column) -> Column:
    return F.upper(spaced_once(value))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty text."""
    return F.coalesce(*[F.when(v != "", v) for v in values[:-1]], values[-1])


def stable_id(*parts: Column) -> Column:
    """A repeatable identifier in place of a random one."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), ID_WIDTH)


def to_json_text(*columns: Column) -> Column:
    """One JSON object text; null members are kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def as_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Any result as one JSON object per row, the export form of the reports."""
    return df.select(to_json_text(*[F.col(c) for c in df.columns]).alias(name))
