"""Which rows each viewer may see."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.model import Tables

C = F.col

# Tables whose rows belong to a user directly, with owner and row key.
_OWNED = {
    "user_trials": ("user_id", "user_id"),
    "user_profiles": ("id", "id"),
    "linked_accounts": ("user_id", "user_id"),
    "user_account_state": ("user_id", "user_id"),
}
# Tables whose rows belong to the user of a live customer, with row key.
_BILLED = {"stripe_subscriptions": "customer_id", "stripe_orders": "id"}


#: What only admins see, all of it, and the column that names its rows.
ADMIN_TABLE, _ADMIN_KEY = "deleted_account_history", "email"


def _owned_rows(t: Tables) -> DataFrame:
    """(viewer_id, table_name, row_key): every row with the user who owns it."""
    customers = t.stripe_customers.filter(C("deleted_at").isNull()).select(
        C("user_id").alias("viewer_id"), "customer_id"
    )

    def tagged(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.select(
            "viewer_id", F.lit(name).alias("table_name"), C(key).cast("string").alias("row_key")
        )

    parts = [tagged(customers, "stripe_customers", "customer_id")]
    for name, (owner, key) in _OWNED.items():
        own = getattr(t, name).select(C(owner).alias("viewer_id"), C(key).alias("key"))
        parts.append(tagged(own, name, "key"))
    for name, key in _BILLED.items():
        rows = getattr(t, name).filter(C("deleted_at").isNull())
        rows = rows.select("customer_id", C(key).alias("key"))
        parts.append(tagged(rows.join(customers, "customer_id"), name, "key"))
    return reduce(DataFrame.unionByName, parts)


def _admins(admins: Collection | DataFrame, like: DataFrame) -> DataFrame:
    """The admins as distinct ``viewer_id``s of the type that ``like`` has."""
    kind = like.schema["viewer_id"].dataType.simpleString()
    if not isinstance(admins, DataFrame):
        admins = like.sparkSession.createDataFrame([(a,) for a in admins], f"viewer_id {kind}")
    return admins.select(C(admins.columns[0]).cast(kind).alias("viewer_id")).distinct()


def entitled_rows(t: Tables, viewers: DataFrame, admins: Collection) -> DataFrame:
    """(viewer_id, table_name, row_key) for every row a viewer may see.

    Owners see their own rows, and live billing rows through their own live
    customer; the deletion history is for admins only. All tables are tagged
    with their owner and meet the viewers in one semi join, which adaptive
    execution can split where one owner has very many rows. Every admin gets every row of
    the history, so this is for a few; ``entitlement_grants`` says the same in short.
    """
    visible = _owned_rows(t)
    if admins:
        # One row per admin and history row is the result itself; the admins
        # are a short literal list.
        kind = viewers.schema["viewer_id"].dataType
        every = F.array(*[F.lit(a).cast(kind) for a in admins])
        seen = t.deleted_account_history.select(
            F.explode(every).alias("viewer_id"),
            F.lit(ADMIN_TABLE).alias("table_name"),
            C(_ADMIN_KEY).cast("string").alias("row_key"),
        )
        visible = visible.unionByName(seen)
    # The viewers are distinct, so an inner join keeps each row once; a semi join
    # would be pushed into every part of the union.
    return visible.join(viewers.select("viewer_id").distinct(), "viewer_id")


def entitlement_grants(
    t: Tables, viewers: DataFrame, admins: Collection | DataFrame
) -> DataFrame:
    """(viewer_id, table_name, scope, row_key): what each viewer may see.

    Scope ``row`` grants one row; scope ``all``, without a row key, grants a whole table.
    So an admin takes one row, however long the history is, and there may be as many
    admins as users.
    """
    asked = viewers.select("viewer_id").distinct()
    own = _owned_rows(t).join(asked, "viewer_id")
    whole = _admins(admins, viewers).join(asked, "viewer_id", "left_semi")
    return own.select("viewer_id", "table_name", F.lit("row").alias("scope"), "row_key").unionByName(
        whole.select(
            "viewer_id",
            F.lit(ADMIN_TABLE).alias("table_name"),
            F.lit("all").alias("scope"),
            F.lit(None).cast("string").alias("row_key"),
        )
    )


def allowed_rows(t: Tables, asked: DataFrame, admins: Collection | DataFrame) -> DataFrame:
    """The asked (viewer_id, table_name, row_key), once each, with ``allowed``.

    What the grants say, for the asked keys alone: the owners' rows meet the asked ones, and
    a grant of a whole table is looked up by viewer, for rows that the table has. Nothing grows
    with admins times rows.
    """
    keys = ["viewer_id", "table_name", "row_key"]
    once = asked.select(*keys).distinct()
    # Asked rows first, so that of the others none is shuffled where few are asked.
    own = _owned_rows(t).join(once, keys, "left_semi").distinct().withColumn("_own", F.lit(True))
    admin = _admins(admins, asked).withColumn("_admin", F.lit(True))
    rows = t.deleted_account_history.select(
        F.lit(ADMIN_TABLE).alias("table_name"),
        C(_ADMIN_KEY).cast("string").alias("row_key"),
        F.lit(True).alias("_there"),
    )
    rows = rows.join(once, ["table_name", "row_key"], "left_semi").distinct()
    judged = (
        once.join(own, keys, "left")
        .join(rows, ["table_name", "row_key"], "left")
        .join(admin, "viewer_id", "left")
    )
    seen = C("_own").isNotNull() | (C("_admin").isNotNull() & C("_there").isNotNull())
    return judged.select(*keys, seen.alias("allowed"))


def rows_of(df: DataFrame, viewer_id: int | str, owner: str = "user_id") -> DataFrame:
    """One viewer's rows of a table or view; the filter reaches the scan."""
    return df.filter(C(owner) == viewer_id)
