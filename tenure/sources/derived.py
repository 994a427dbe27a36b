"""Lifecycle tables derived from the generic test tables.

The test data holds customers, orders and events, but no subscription tables.
Each ``Recipe`` derives one lifecycle table by plain arithmetic in SQL text
that Spark and DuckDB read alike (``{ts}`` is the zone-less timestamp type of
the dialect), so that both engines start from the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tenure.model import SCHEMAS, Tables, struct
from tenure.operators.keyed import extreme_per_key
from tenure.sources.tables import read_stream

AS_OF = "2024-01-31 00:00:00"
PROTECTED_IDS = (1, 5, 11)

RAW_SCHEMAS = {
    "customer": struct(
        c_custkey="long",
        c_name="string",
        c_nationkey="int",
        c_acctbal="double",
        c_mktsegment="string",
    ),
    "orders": struct(
        o_orderkey="long",
        o_custkey="long",
        o_orderstatus="string",
        o_totalprice="double",
        o_orderdate="ts",
        o_orderpriority="string",
    ),
    "events": struct(
        event_id="long",
        ts="ts",
        user_id="long",
        event_type="string",
        value="double",
        props="string",
    ),
}


@dataclass(frozen=True)
class Pick:
    """Keep the newest or oldest source row per key before projecting."""

    key: str
    key_sql: str
    order: Sequence[str]
    newest: bool = True


@dataclass(frozen=True)
class Recipe:
    source: str
    columns: dict[str, str]
    where: str | None = None
    pick: Pick | None = None
    keep: Sequence[str] = field(default=())


def _now(ts: str) -> str:
    return f"cast('{AS_OF}' as {ts})"


def recipes(ts: str) -> dict[str, list[Recipe]]:
    """The recipes in the dialect whose zone-less timestamp type is ``ts``.

    A table with several recipes is their union.
    """
    now = _now(ts)
    no_time, no_text = f"cast(null as {ts})", "cast(null as string)"
    closed = f"cast('2024-01-30 00:00:00' as {ts})"
    joined = (
        f"{now} - ((c_custkey * 37) % 21) * INTERVAL '1' DAY"
        " - (c_custkey % 23) * INTERVAL '1' HOUR - INTERVAL '17' MINUTE"
    )
    email = "concat(lower(c_name), '@example.com')"
    customer_id = "concat('cus_', cast(c_custkey as string))"
    scheduled = (
        "c_custkey % 13 <> 0 and (c_custkey % 5 = 0 or c_custkey % 11 = 0)"
        " and c_custkey % 10 <> 0"
    )
    status_of = (
        "case {0} % 9 when 0 then 'not_started' when 1 then 'incomplete'"
        " when 2 then 'incomplete_expired' when 3 then 'trialing' when 4 then 'active'"
        " when 5 then 'past_due' when 6 then 'canceled' when 7 then 'unpaid'"
        " else 'paused' end"
    )
    event_customer = (
        "case when event_id % 50 <> 0 then concat('cus_', cast(user_id as string)) end"
    )
    carries_subscription = (
        "event_type in ('signup', 'view') and event_id % 50 <> 0 and event_id % 13 = 0"
    )
    user_email = (
        "concat('customer#', lpad(cast(user_id as string), 9, '0'), '@example.com')"
    )
    paid = "event_type = 'purchase'"

    def when(condition: str, value: str) -> str:
        return f"case when {condition} then {value} end"

    def newest_event(event_type: str, columns: dict[str, str], newest: bool = True) -> Recipe:
        return Recipe(
            "events",
            columns,
            where=f"event_type = '{event_type}'",
            pick=Pick("user_id", "user_id", ("ts", "event_id"), newest),
            keep=("event_id", "ts"),
        )

    return {
        "users": [
            Recipe(
                "customer",
                {
                    "user_id": "c_custkey",
                    "email": email,
                    "full_name": "c_name",
                    "created_at": joined,
                },
            )
        ],
        "stripe_customers": [
            Recipe(
                "customer",
                {
                    "id": "c_custkey",
                    "user_id": "c_custkey",
                    "customer_id": customer_id,
                    "stripe_customer_email": email,
                    "last_sync_at": joined,
                    "sync_errors": "'[]'",
                    "created_at": joined,
                    "updated_at": joined,
                    "deleted_at": when("c_custkey % 29 = 0", closed),
                },
                where="c_custkey % 4 <> 0",
            )
        ],
        "stripe_subscriptions": [
            Recipe(
                "orders",
                {
                    "id": "o_orderkey",
                    "customer_id": "customer_id",
                    "subscription_id": "concat('sub_', cast(o_orderkey as string))",
                    "price_id": "case when o_orderkey % 2 = 0 then 'price_pro' else 'trial_price' end",
                    "current_period_start": "1704067200 + (o_orderkey % 30) * 86400",
                    "current_period_end": "1704067200 + (o_orderkey % 30) * 86400 + 2592000",
                    "cancel_at_period_end": "o_orderkey % 10 = 0",
                    "payment_method_brand": when("o_orderkey % 4 <> 0", "'visa'"),
                    "payment_method_last4": when(
                        "o_orderkey % 4 <> 0",
                        "lpad(cast(o_orderkey % 10000 as string), 4, '0')",
                    ),
                    "status": status_of.format("o_orderkey"),
                    "created_at": "o_orderdate",
                    "updated_at": "o_orderdate",
                    "deleted_at": when("o_orderkey % 31 = 0", closed),
                },
                where="o_custkey % 4 <> 0 and o_custkey % 7 <> 0",
                # Grouped by the text key that the joins use, so that the
                # grouping and the next join share one shuffle.
                pick=Pick(
                    "customer_id",
                    "concat('cus_', cast(o_custkey as string))",
                    ("o_orderdate", "o_orderkey"),
                ),
                keep=("o_orderkey", "o_orderdate"),
            )
        ],
        "stripe_orders": [
            Recipe(
                "orders",
                {
                    "id": "o_orderkey",
                    "checkout_session_id": "concat('cs_', cast(o_orderkey as string))",
                    "payment_intent_id": "concat('pi_', cast(o_orderkey as string))",
                    "customer_id": "concat('cus_', cast(o_custkey as string))",
                    "amount_subtotal": "cast(round(o_totalprice * 100) as bigint) - (o_orderkey % 500)",
                    "amount_total": "cast(round(o_totalprice * 100) as bigint)",
                    "currency": "'usd'",
                    "payment_status": "case when o_orderstatus = 'O' then 'unpaid' else 'paid' end",
                    "status": "case o_orderstatus when 'F' then 'completed'"
                    " when 'O' then 'pending' else 'canceled' end",
                    "created_at": "o_orderdate",
                    "updated_at": "o_orderdate",
                    "deleted_at": when("o_orderkey % 31 = 0", closed),
                },
            )
        ],
        "user_trials": [
            Recipe(
                "customer",
                {
                    "id": "c_custkey",
                    "user_id": "c_custkey",
                    "trial_start_date": joined,
                    "trial_end_date": f"{joined} + INTERVAL '7' DAY",
                    "trial_status": "case when c_custkey % 13 = 0 then 'converted_to_paid'"
                    " when c_custkey % 5 = 0 then 'expired'"
                    " when c_custkey % 11 = 0 then 'scheduled_for_deletion' else 'active' end",
                    "deletion_scheduled_at": when(
                        scheduled, f"{joined} + INTERVAL '8' DAY + INTERVAL '1' HOUR"
                    ),
                    "created_at": joined,
                    "updated_at": joined,
                },
            )
        ],
        "user_profiles": [
            Recipe(
                "customer",
                {
                    "id": "c_custkey",
                    "email": email,
                    "full_name": when("c_custkey % 3 <> 0", "c_name"),
                    "avatar_url": no_text,
                    "phone": no_text,
                    "company": "c_mktsegment",
                    "created_at": joined,
                    "updated_at": joined,
                    "last_login_at": no_time,
                    "is_active": "c_custkey % 37 <> 0",
                    "metadata": "'{}'",
                },
                where="c_custkey % 41 <> 0",
            )
        ],
        "linked_accounts": [
            Recipe(
                "customer",
                {
                    "id": "c_custkey",
                    "user_id": "c_custkey",
                    "external_user_id": "concat('ext_', cast(c_custkey as string))",
                    "external_email": email,
                    "account_status": "case c_custkey % 17 when 0 then 'suspended'"
                    " when 1 then 'deleted' else 'active' end",
                    "created_at": joined,
                    "updated_at": joined,
                    "last_sync_at": f"{joined} + INTERVAL '1' DAY",
                    "sync_errors": "'[]'",
                },
                where="c_custkey % 3 <> 1",
            )
        ],
        "user_account_state": [
            Recipe(
                "customer",
                {
                    "user_id": "c_custkey",
                    "account_status": "'trial_active'",
                    "has_access": "true",
                    "access_level": "'trial'",
                    "trial_start_date": joined,
                    "trial_end_date": f"{joined} + INTERVAL '7' DAY",
                    "trial_days_remaining": "7",
                    "stripe_customer_id": no_text,
                    "stripe_subscription_id": no_text,
                    "subscription_status": no_text,
                    "current_period_end": no_time,
                    "external_user_id": no_text,
                    "external_status": no_text,
                    "created_at": joined,
                    "updated_at": joined,
                    "last_activity_at": joined,
                    "notes": no_text,
                    "admin_flags": "'{}'",
                },
                where="c_custkey % 19 <> 0",
            )
        ],
        "deleted_account_history": [
            Recipe(
                "customer",
                {
                    "id": "concat('del_', cast(c_custkey as string))",
                    "original_user_id": "c_custkey",
                    "email": email,
                    "full_name": when("c_custkey % 12 <> 0", "c_name"),
                    "trial_used": "true",
                    "trial_start_date": f"{joined} - INTERVAL '60' DAY",
                    "trial_end_date": f"{joined} - INTERVAL '53' DAY",
                    "trial_completed": "c_custkey % 18 = 0",
                    "ever_subscribed": "c_custkey % 18 = 0",
                    "last_subscription_status": when("c_custkey % 18 = 0", "'canceled'"),
                    "subscription_cancelled_date": when(
                        "c_custkey % 18 = 0", f"{joined} - INTERVAL '51' DAY"
                    ),
                    "account_deleted_at": f"{joined} - INTERVAL '50' DAY",
                    "deletion_reason": "'trial_expired'",
                    "can_get_new_trial": "false",
                    "requires_immediate_subscription": "true",
                    "created_at": f"{joined} - INTERVAL '50' DAY",
                    "updated_at": f"{joined} - INTERVAL '50' DAY",
                },
                where="c_custkey % 6 = 0",
            )
        ],
        "webhook_events": [
            Recipe(
                "events",
                {
                    "event_id": "event_id",
                    "malformed": "case when event_id % 97 = 0 then concat('{', event_type) end",
                    "type": "case event_type when 'signup' then 'customer.subscription.created'"
                    " when 'view' then 'customer.subscription.updated'"
                    " when 'error' then 'invoice.payment_failed'"
                    " when 'purchase' then 'checkout.session.completed'"
                    " else 'payment_intent.succeeded' end",
                    "created": "ts",
                    "customer": event_customer,
                    "mode": when(
                        paid,
                        "case when event_id % 3 = 0 then 'subscription' else 'payment' end",
                    ),
                    "payment_status": when(
                        paid, "case when event_id % 4 = 0 then 'unpaid' else 'paid' end"
                    ),
                    "invoice": "case when event_type = 'click' and event_id % 2 = 0"
                    " then null else 'in_x' end",
                    "checkout_session_id": when(
                        paid,
                        "concat('cs_', cast(user_id as string), '_', cast(event_id % 10 as string))",
                    ),
                    "payment_intent_id": when(paid, "concat('pi_', cast(event_id as string))"),
                    "amount_subtotal": "cast(round(value * 100) as bigint)",
                    "amount_total": "cast(round(value * 100) as bigint) + event_id % 7",
                    "currency": "'usd'",
                    "subscription_id": when(
                        carries_subscription, "concat('sub_e', cast(event_id as string))"
                    ),
                    "subscription_status": when(
                        carries_subscription, status_of.format("event_id")
                    ),
                    "price_id": when(
                        carries_subscription,
                        "case when event_id % 2 = 0 then 'price_pro' else 'trial_price' end",
                    ),
                    "current_period_start": when(
                        carries_subscription, "1704067200 + (event_id % 30) * 86400"
                    ),
                    "current_period_end": when(
                        carries_subscription, "1704067200 + (event_id % 30) * 86400 + 2592000"
                    ),
                    "cancel_at_period_end": when(carries_subscription, "event_id % 10 = 0"),
                    # An older subscription's event may come after a newer one's.
                    "subscription_created": when(
                        carries_subscription, "ts - INTERVAL '1' DAY * (event_id % 13)"
                    ),
                    # Every eighth brings a payment method that is no card.
                    "payment_method_given": when(
                        carries_subscription, "event_id % 4 <> 0 or event_id % 8 = 0"
                    ),
                    "payment_method_brand": when(
                        f"{carries_subscription} and event_id % 4 <> 0", "'mastercard'"
                    ),
                    "payment_method_last4": when(
                        f"{carries_subscription} and event_id % 4 <> 0",
                        "lpad(cast(event_id % 10000 as string), 4, '0')",
                    ),
                },
            )
        ],
        "external_directory": [
            Recipe(
                "linked_accounts",
                {
                    "id": "external_user_id",
                    "username": "external_email",
                    "is_active": "true",
                    "is_superuser": "false",
                },
                where="user_id % 8 <> 0",
            ),
            Recipe(
                "linked_accounts",
                {
                    "id": "concat('orphan', cast(user_id as string))",
                    "username": "concat('orphan', cast(user_id as string), '@example.com')",
                    "is_active": "true",
                    "is_superuser": "false",
                },
                where="user_id % 50 = 0",
            ),
        ],
        # Input batches of the keyed jobs.
        "signups": [
            newest_event(
                "signup",
                {
                    "user_id": "user_id + 1000000000",
                    "email": user_email,
                    "full_name": no_text,
                    "created_at": "ts",
                },
                newest=False,
            )
        ],
        "profile_batch": [
            newest_event(
                "signup",
                {
                    "user_id": "user_id",
                    "email": "concat('user', cast(user_id as string), '@example.org')",
                    "full_name": when(
                        "event_id % 2 <> 0", "concat('User ', cast(user_id as string))"
                    ),
                },
            )
        ],
        "link_batch": [
            newest_event(
                "view",
                {
                    "user_id": "user_id",
                    "external_user_id": "concat('ext_v', cast(event_id as string))",
                    "external_email": "concat('user', cast(user_id as string), '@example.org')",
                },
            )
        ],
        "customer_link_batch": [
            newest_event(
                "click",
                {
                    "user_id": "user_id",
                    "customer_id": "case when event_id % 3 <> 0"
                    " then concat('cus_', cast(user_id as string))"
                    " else concat('cus_other', cast(user_id as string)) end",
                    "email": "concat('billing', cast(user_id as string), '@example.org')",
                },
            )
        ],
        "restore_batch": [
            newest_event(
                "purchase",
                {
                    "user_id": "user_id",
                    "email": user_email,
                    "customer_id": "concat('cus_', cast(user_id as string))",
                    "subscription_id": "concat('sub_r', cast(event_id as string))",
                },
            )
        ],
        "delete_requests": [
            newest_event(
                "error",
                {
                    "user_id": "case when event_id % 7 = 0 then user_id + 5000000000"
                    " else user_id end",
                },
            )
        ],
        "checkout_bodies": [
            Recipe(
                "events",
                {
                    "event_id": "event_id",
                    "body": "concat('{', case when event_id % 11 = 0 then '' when event_id % 19 = 0"
                    " then concat('\"price_id\":', cast(event_id as string), ',')"
                    " else '\"price_id\":\"price_pro\",' end,"
                    " '\"success_url\":\"https://example.com/ok\",',"
                    " case when event_id % 17 = 0 then '\"cancel_url\":null,'"
                    " else '\"cancel_url\":\"https://example.com/no\",' end,"
                    " case when event_id % 13 = 0 then '\"mode\":\"bad\"'"
                    " when event_id % 3 = 0 then '\"mode\":\"subscription\"'"
                    " else '\"mode\":\"payment\"' end, '}')",
                },
                where="event_type = 'purchase'",
            )
        ],
        "checkout_requests": [
            Recipe(
                "events",
                {
                    "event_id": "event_id",
                    "user_id": "user_id",
                    "price_id": when(
                        "event_id % 11 <> 0",
                        "case when event_id % 2 = 0 then 'price_pro' else 'trial_price' end",
                    ),
                    "success_url": "'https://example.com/ok'",
                    "cancel_url": when("event_id % 17 <> 0", "'https://example.com/no'"),
                    "mode": "case when event_id % 13 = 0 then 'bad'"
                    " when event_id % 3 = 0 then 'subscription' else 'payment' end",
                    "created_at": "ts",
                },
                where="event_type = 'purchase'",
            )
        ],
    }


def _columns(name: str, recipe: Recipe) -> list[str]:
    """The projection as SQL, cast to the declared types where there are any."""
    types = {f.name: f.dataType.simpleString() for f in SCHEMAS.get(name, ())}
    return [
        f"cast({sql} as {types[column]}) as {column}" if column in types else f"{sql} as {column}"
        for column, sql in recipe.columns.items()
    ]


def _derive(name: str, recipe: Recipe, source: DataFrame) -> DataFrame:
    df = source.filter(recipe.where) if recipe.where else source
    if recipe.pick:
        pick = recipe.pick
        df = df.selectExpr(f"{pick.key_sql} as {pick.key}", *recipe.keep)
        df = extreme_per_key(df, [pick.key], pick.order, pick.newest)
    return df.selectExpr(*_columns(name, recipe))


def derived_stream(
    spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None
) -> DataFrame:
    """A derived table's rows as a stream over its source file.

    Of a table that picks one row per key, the stream brings all rows, with
    the columns that decide the pick.
    """
    (recipe,) = recipes("timestamp_ntz")[name]
    df = read_stream(
        spark,
        sf_dir,
        RAW_SCHEMAS[recipe.source],
        glob=f"{recipe.source}*.parquet",
        files_per_batch=files_per_batch,
    )
    df = df.filter(recipe.where) if recipe.where else df
    return df.selectExpr(*_columns(name, recipe), *recipe.keep)


def derived_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All lifecycle tables and input batches derived from ``sf_dir``."""
    book = recipes("timestamp_ntz")
    raw: dict[str, DataFrame] = {}

    def source(name: str) -> DataFrame:
        if name in book:
            return getattr(tables, name)
        if name not in raw:
            raw[name] = spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
        return raw[name]

    def load(name: str) -> DataFrame:
        parts = [_derive(name, r, source(r.source)) for r in book[name]]
        return reduce(DataFrame.unionByName, parts)

    tables = Tables(load, names=tuple(book))
    return tables
