"""Billing events, checkout requests and the external directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions import clock
from tenure.model import PAYING_STATUSES, Tables
from tenure.operators.keyed import (
    apply_update,
    extreme_per_key,
    insert_if_absent,
    match_presence,
    upsert,
)
from tenure.plans.access import live

C = F.col

# The subscription columns that an event carries, beside the status.
_CARRIED = (
    "subscription_id",
    "price_id",
    "current_period_start",
    "current_period_end",
    "cancel_at_period_end",
)
_METHOD = ("payment_method_brand", "payment_method_last4")
_EVENT_ORDER = ("created", "event_id")


def route() -> Column:
    """What an event leads to; the first rule that holds decides."""
    checkout = C("type") == "checkout.session.completed"
    one_time = ~C("mode").eqNullSafe("subscription")
    paid = (C("mode") == "payment") & (C("payment_status") == "paid")
    return (
        F.when(C("malformed").isNotNull(), F.lit("malformed"))
        .when(C("customer").isNull(), F.lit("skip_no_customer"))
        .when(
            (C("type") == "payment_intent.succeeded") & C("invoice").isNull(),
            F.lit("skip_one_time_intent"),
        )
        .when(checkout & one_time & paid, F.lit("order_insert"))
        .when(checkout & one_time, F.lit("ignored"))
        .otherwise(F.lit("subscription_sync"))
    )


def webhook_routes(events: DataFrame) -> DataFrame:
    """Where each event goes; of a line that is no event, also the line."""
    return events.select("event_id", route().alias("route"), "malformed")


# Subscriptions --------------------------------------------------------------


def sync_candidates(events: DataFrame) -> DataFrame:
    """One row per event that asks for a sync, with the subscription it carries."""
    carries = C("subscription_id").isNotNull()
    return events.filter(route() == "subscription_sync").select(
        C("customer").alias("customer_id"),
        C("subscription_status").alias("status"),
        *_CARRIED,
        *_METHOD,
        C("payment_method_given").alias("method_given"),
        F.when(carries, C("subscription_created")).alias("subscription_created"),
        F.when(carries, C("created")).alias("event_at"),
        F.when(carries, C("event_id")).alias("event_id"),
    )


def newest_candidate(candidates: DataFrame) -> Column:
    """The aggregate that picks a customer's newest subscription: the one made
    last, as its own newest event has it. An old subscription's late event does
    not win over a newer subscription."""
    rest = [c for c in candidates.columns if c != "customer_id"]
    order = F.when(
        C("event_at").isNotNull(), F.struct("subscription_created", "event_at", "event_id")
    )
    return F.max_by(F.struct(*rest), order)


def newest_candidates(candidates: DataFrame) -> DataFrame:
    """Per customer, the newest subscription among the candidates.

    A customer whose events carry none gets empty columns. One aggregate with
    partial results before the shuffle; rows without a subscription do not
    take part in the choice. Newest of newest is newest, so the results of
    several batches can be reduced again.
    """
    newest = newest_candidate(candidates).alias("sub")
    return candidates.groupBy("customer_id").agg(newest).select("customer_id", "sub.*")


def newest_subscriptions(events: DataFrame) -> DataFrame:
    return newest_candidates(sync_candidates(events))


def merge_subscriptions(
    subscriptions: DataFrame, newest: DataFrame, as_of: clock.Instant
) -> DataFrame:
    """The next subscriptions, given the newest one per customer.

    Events that carry no subscription say nothing about a stored one; they only
    give an unknown customer a first status. A payment method that came with the
    subscription replaces the old one, also with empty columns if it is no card;
    a bare reference to one changes nothing.
    """
    now = clock.instant(as_of)
    found = C("new.subscription_id").isNotNull()
    has_method = F.coalesce(C("new.method_given"), F.lit(False))
    has_method = found & (has_method | C("new.payment_method_brand").isNotNull())
    update = {c: F.when(found, C(f"new.{c}")).otherwise(C(f"old.{c}")) for c in _CARRIED}
    update |= {c: F.when(has_method, C(f"new.{c}")).otherwise(C(f"old.{c}")) for c in _METHOD}
    insert = {c: C(f"new.{c}") for c in (*_CARRIED, *_METHOD)}
    insert |= {
        "id": F.xxhash64("new.customer_id"),
        "cancel_at_period_end": F.when(found, C("new.cancel_at_period_end")).otherwise(False),
        "created_at": now,
        "updated_at": now,
    }
    return upsert(
        subscriptions,
        newest,
        "customer_id",
        update={**update, "status": F.when(found, C("new.status")).otherwise(C("old.status"))},
        insert={**insert, "status": F.coalesce("new.status", F.lit("not_started"))},
    )


def subscription_upsert(t: Tables, events: DataFrame, as_of: clock.Instant) -> DataFrame:
    return merge_subscriptions(t.stripe_subscriptions, newest_subscriptions(events), as_of)


def paying_customers(changed: DataFrame) -> DataFrame:
    """The customers that a changed subscription row makes payers."""
    return changed.filter(C("status").isin(*PAYING_STATUSES)).select("customer_id").distinct()


def subscription_change_effects(
    t: Tables, changed: DataFrame, as_of: clock.Instant
) -> DataFrame:
    """The next trials after subscription rows (customer_id, status) changed:
    whoever pays now is converted, whatever the trial's state."""
    customers = live(t.stripe_customers).select("user_id", "customer_id")
    users = customers.join(paying_customers(changed), "customer_id", "left_semi")
    return apply_update(
        t.user_trials,
        users.select("user_id").distinct(),
        "user_id",
        {
            "trial_status": F.lit("converted_to_paid"),
            "deletion_scheduled_at": F.lit(None),
            "updated_at": clock.instant(as_of),
        },
    )


def subscription_changes(events: DataFrame) -> DataFrame:
    """The subscription rows that the events write, as (customer_id, status)."""
    return events.filter(
        (route() == "subscription_sync") & C("subscription_id").isNotNull()
    ).select(C("customer").alias("customer_id"), C("subscription_status").alias("status"))


# Orders ---------------------------------------------------------------------


def paid_orders(events: DataFrame) -> DataFrame:
    """One completed order per paid one-time checkout event."""
    return events.filter(route() == "order_insert").select(
        "checkout_session_id",
        "payment_intent_id",
        C("customer").alias("customer_id"),
        "amount_subtotal",
        "amount_total",
        "currency",
        "payment_status",
        F.lit("completed").alias("status"),
        "created",
        "event_id",
    )


def first_orders(orders: DataFrame) -> DataFrame:
    """The first event of each checkout session; repeated events add nothing."""
    return extreme_per_key(orders, ["checkout_session_id"], _EVENT_ORDER, newest=False)


def order_inserts(events: DataFrame) -> DataFrame:
    """The orders to insert, one per checkout session."""
    return first_orders(paid_orders(events)).drop(*_EVENT_ORDER)


def insert_orders(t: Tables, first: DataFrame) -> DataFrame:
    """The next orders: sessions that have an order already are left alone."""
    rows = first.select(
        F.xxhash64("checkout_session_id").alias("id"),
        "*",
        C("created").alias("created_at"),
        C("created").alias("updated_at"),
    )
    return insert_if_absent(t.stripe_orders, rows, "checkout_session_id", repeated=True)


def orders_after(t: Tables, events: DataFrame) -> DataFrame:
    return insert_orders(t, first_orders(paid_orders(events)))


# Checkout -------------------------------------------------------------------

# The checked parameters in order; the last one is a choice.
REQUIRED_TEXTS = ("price_id", "success_url", "cancel_url")
MODES = ("payment", "subscription")


def checkout_reason() -> Column:
    """Why a request is refused, by its first failing parameter; null if sound."""
    reason = F.when(
        ~F.coalesce(C("mode").isin(*MODES), F.lit(False)),
        F.lit(f"Expected parameter mode to be one of {', '.join(MODES)}"),
    )
    for name in reversed(REQUIRED_TEXTS):
        reason = F.when(
            C(name).isNull(), F.lit(f"Missing required parameter {name}")
        ).otherwise(reason)
    return reason


def checkout_validation(requests: DataFrame) -> DataFrame:
    return requests.select("event_id", checkout_reason().alias("reason"))


def checkout_body_validation(bodies: DataFrame) -> DataFrame:
    """The same check on raw JSON bodies (event_id, body), where a parameter
    may also have the wrong type."""
    parsed = bodies.withColumn("_body", F.parse_json("body"))
    for name in (*REQUIRED_TEXTS, "mode"):
        parsed = parsed.withColumn(name, F.try_variant_get("_body", f"$.{name}", "variant"))

    def kind(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(C(name)), F.lit("VOID"))

    choice = F.when(kind("mode") == "STRING", F.try_variant_get("mode", "$", "string"))
    reason = F.when(
        ~F.coalesce(choice.isin(*MODES), F.lit(False)),
        F.lit(f"Expected parameter mode to be one of {', '.join(MODES)}"),
    )
    for name in reversed(REQUIRED_TEXTS):
        wrong = F.concat(
            F.lit(f"Expected parameter {name} to be a string got "), F.to_json(C(name))
        )
        reason = (
            F.when(kind(name) == "VOID", F.lit(f"Missing required parameter {name}"))
            .when(kind(name) != "STRING", wrong)
            .otherwise(reason)
        )
    return parsed.select("event_id", reason.alias("reason"))


def _customers_with_subscription(t: Tables) -> DataFrame:
    """All customers, deleted ones too, and whether they have any subscription.

    Customers meet their subscriptions before the requests join, so that the
    requests join once, on the user alone.
    """
    held = t.stripe_subscriptions.select("customer_id", F.lit(True).alias("_subscribed"))
    return (
        t.stripe_customers.select("user_id", "customer_id", "deleted_at")
        .join(held, "customer_id", "left")
        .withColumn("_exists", F.lit(True))
    )


def _action(wants_subscription: Column) -> Column:
    return (
        F.when(
            C("_exists").isNull() & wants_subscription,
            F.lit("create_customer_and_subscription"),
        )
        .when(C("_exists").isNull(), F.lit("create_customer"))
        .when(C("deleted_at").isNotNull(), F.lit("conflict_soft_deleted"))
        .when(wants_subscription & C("_subscribed").isNull(), F.lit("create_subscription"))
        .otherwise(F.lit("ready"))
    )


def checkout_provisioning(t: Tables, requests: DataFrame) -> DataFrame:
    """What each sound request needs before its checkout, by today's tables."""
    sound = requests.filter(checkout_reason().isNull()).select("event_id", "user_id", "mode")
    joined = sound.join(_customers_with_subscription(t), "user_id", "left")
    return joined.select(
        "event_id", "user_id", _action(C("mode") == "subscription").alias("action")
    )


def checkout_inserts(t: Tables, requests: DataFrame) -> DataFrame:
    """The rows to insert for a batch of requests, once per user.

    Requests are reduced to one row per user before they are shuffled, so a
    user with very many requests is no burden to the join.
    """
    sound = requests.filter(checkout_reason().isNull())
    users = sound.groupBy("user_id").agg(F.bool_or(C("mode") == "subscription").alias("_wants"))
    joined = users.join(_customers_with_subscription(t), "user_id", "left")
    made = F.concat(F.lit("cus_new_"), C("user_id").cast("string"))
    return (
        joined.withColumn("action", _action(C("_wants")))
        .filter(C("action").startswith("create"))
        .select(
            "user_id",
            F.coalesce("customer_id", made).alias("customer_id"),
            C("action").startswith("create_customer").alias("insert_customer"),
            C("action").endswith("subscription").alias("insert_subscription"),
            F.lit("not_started").alias("subscription_status"),
        )
    )


# External directory ---------------------------------------------------------


def external_directory_match(t: Tables, directory: DataFrame) -> DataFrame:
    """Which emails are on both sides, missing outside, or only outside."""
    local = t.linked_accounts.select(C("external_email").alias("email"))
    remote = directory.select(C("username").alias("email"))
    return match_presence(local, remote, "email").select(
        "email",
        F.when(C("in_left") & C("in_right"), F.lit("matched"))
        .when(C("in_left"), F.lit("missing_outside"))
        .otherwise(F.lit("orphan_outside"))
        .alias("match_state"),
    )
