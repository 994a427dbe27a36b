"""Documents without, or with, named rows, and without moving the texts of all others.

A row is named by its id and the ``text_key`` of its text. Up to BROADCAST_ROWS names are
sent to every executor. Beyond that a Bloom filter of them is, up to a fixed size, and
only rows that may be named are shuffled. More names than that filter takes meet the rows
in a plain join.

Defined results. Null ids are equal to each other; null and empty texts are alike.
Repeated names count once, repeated rows go or stay together. No names leave every
row, and an empty table is empty. The rows' columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm import columns, url_filter
from tenure.llm.columns import text_key


def _joined(rows: DataFrame, names: DataFrame, id_: Column, key: Column, how: str) -> DataFrame:
    same = id_.eqNullSafe(names["_named_id"]) & (key == names["_named_key"])
    return rows.join(names, same, how)


def _split(rows: DataFrame, names: DataFrame, count: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows, packed, that are surely not named, and those that may be."""
    def told(id_: Column, key: Column) -> Column:
        return F.concat_ws(" ", id_.cast("string"), key)

    listed = names.select(told(F.col("_named_id"), F.col("_named_key")).alias("canonical"))
    packed = rows.select(
        F.struct(*(rows[c] for c in rows.columns)).alias("_row"),
        rows[id_col].alias("_id"), text_key(rows[text_col]).alias("_key"),
    ).select("*", told(F.col("_id"), F.col("_key")).alias("canonical"), F.lit(None).alias("_verdict"))
    looked = url_filter.looked_up(packed, listed, count)
    return looked.filter("not _possible"), looked.filter("_possible")


def named_rows(
    rows: DataFrame, names: DataFrame, id_col: str, text_col: str, without: bool
) -> DataFrame:
    """The rows that are, or (``without``) are not, among the names ``_named_id, _named_key``, which are saved."""
    how = "left_anti" if without else "left_semi"
    count = names.count()
    id_, key = rows[id_col], text_key(rows[text_col])
    if count <= columns.BROADCAST_ROWS:
        return _joined(rows, F.broadcast(names), id_, key, how)
    if url_filter.word_total(count) > url_filter.BROADCAST_WORDS:
        return _joined(rows, names, id_, key, how)
    clear, possible = _split(rows, names, count, id_col, text_col)
    kept = _joined(possible, names, possible["_id"], possible["_key"], how).select("_row")
    if without:
        kept = clear.select("_row").unionByName(kept)
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in rows.columns))
