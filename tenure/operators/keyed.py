"""Operators on keyed tables: newest row, upsert, update, insert, diff.

Tables are immutable snapshots: each operator returns the full next snapshot.
Inside update and insert expressions, the target row is ``old.<column>`` and
the incoming row is ``new.<column>``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def extreme_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], newest: bool = True
) -> DataFrame:
    """The newest (or oldest) row per key.

    An aggregate, not a window: map tasks keep one row per key before the
    shuffle, so a key that holds a third of all rows costs no more than others.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if set(rest) == set(order):
        best = (F.max if newest else F.min)(F.struct(*order))
    else:
        best = (F.max_by if newest else F.min_by)(F.struct(*rest), F.struct(*order))
    best = best.alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in declared order and type; missing ones become null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def one_per_key(source: DataFrame, key: str) -> DataFrame:
    """One row per key: of rows that repeat a key, the one with the largest values.

    A batch that brings a key twice, as a repeated call does, then counts once.
    Map tasks reduce their rows first, so repeats are not shuffled.
    """
    rest = [c for c in source.columns if c != key]
    if not rest:
        return source.distinct()
    best = source.groupBy(key).agg(F.max(F.struct(*rest)).alias("_one"))
    return best.select(key, "_one.*").select(*source.columns)


def upsert(
    target: DataFrame,
    source: DataFrame,
    key: str,
    update: Mapping[str, Column],
    insert: Mapping[str, Column],
) -> DataFrame:
    """Insert new keys and change given columns of known ones.

    Repeated keys of ``source`` count once (see ``one_per_key``). One full outer
    join reads and shuffles each side once, whatever the two sizes.
    Columns absent from ``update`` keep their old value; columns absent from
    ``insert`` are null in new rows.
    """
    old = target.withColumn("_known", F.lit(True)).alias("old")
    new = one_per_key(source, key).withColumn("_given", F.lit(True)).alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    known, given = F.col("old._known").isNotNull(), F.col("new._given").isNotNull()
    out = []
    for field in target.schema.fields:
        name, kept = field.name, F.col(f"old.{field.name}")
        if name == key:
            value = F.coalesce(kept, F.col(f"new.{key}"))
        else:
            changed = F.when(given, update[name]).otherwise(kept) if name in update else kept
            value = F.when(known, changed).otherwise(insert.get(name, F.lit(None)))
        out.append(value.cast(field.dataType).alias(name))
    return joined.select(*out)


def insert_if_absent(
    target: DataFrame, source: DataFrame, key: str, repeated: bool = False
) -> DataFrame:
    """Add the source rows whose key is unknown, once each; known rows stay untouched.

    Only the target's keys are shuffled, never its full rows. Where the target
    may hold a key many times (``repeated``), keys are reduced before that.
    """
    keys = target.select(key)
    fresh = one_per_key(source, key).join(keys.distinct() if repeated else keys, key, "left_anti")
    return target.unionByName(conform(fresh, target.schema))


def apply_update(
    target: DataFrame, source: DataFrame, key: str, sets: Mapping[str, Column]
) -> DataFrame:
    """Change columns of the rows whose key is in ``source``; repeated keys count once."""
    old = target.alias("old")
    new = one_per_key(source, key).withColumn("_given", F.lit(True)).alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "left")
    given = F.col("new._given").isNotNull()
    return joined.select(
        *[
            (
                F.when(given, sets[f.name]).otherwise(F.col(f"old.{f.name}"))
                if f.name in sets
                else F.col(f"old.{f.name}")
            )
            .cast(f.dataType)
            .alias(f.name)
            for f in target.schema.fields
        ]
    )


def change_feed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """What changed between two snapshots: key, op and the changed columns."""
    old = before.withColumn("_old", F.lit(True)).alias("old")
    new = after.withColumn("_new", F.lit(True)).alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    names = [
        F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c))
        for c in before.columns
        if c != key
    ]
    both = F.col("old._old").isNotNull() & F.col("new._new").isNotNull()
    return joined.select(
        F.coalesce(F.col(f"old.{key}"), F.col(f"new.{key}")).alias(key),
        F.when(F.col("old._old").isNull(), F.lit("INSERT"))
        .when(F.col("new._new").isNull(), F.lit("DELETE"))
        .otherwise(F.lit("UPDATE"))
        .alias("op"),
        F.when(both, F.concat_ws(",", *names)).otherwise(F.lit("")).alias("changed_columns"),
    ).filter((F.col("op") != "UPDATE") | (F.col("changed_columns") != ""))


def match_presence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each distinct key with the sides that hold it.

    The two key columns are unioned and grouped once, with partial sums before
    the shuffle; repeated keys on both sides never multiply.
    """
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return tagged.groupBy(key).agg(
        (F.max("l") == 1).alias("in_left"), (F.max("r") == 1).alias("in_right")
    )
