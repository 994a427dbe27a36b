"""Access, trial and billing views, for all users at once.

Two ways of dropping soft-deleted rows coexist and differ in their results:

* *before* the outer join: the customer stays, with empty subscription columns;
* *after* the outer join: a customer whose only subscription or order is
  deleted disappears.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions import clock, text
from tenure.model import PAYING_STATUSES, TRIAL_DAYS, Tables
from tenure.sources.products import product_name, product_structs

C = F.col

SUBSCRIPTION_COLUMNS = (
    "subscription_id",
    "price_id",
    "current_period_start",
    "current_period_end",
    "cancel_at_period_end",
    "payment_method_brand",
    "payment_method_last4",
)

#: A list of up to so many ids becomes part of the plan; a longer one is joined.
INLINE_IDS = 100

Protected = Collection | DataFrame


def live(df: DataFrame) -> DataFrame:
    return df.filter(C("deleted_at").isNull())


def flag_protected(df: DataFrame, protected: Protected, key: str = "user_id") -> DataFrame:
    """Adds ``_safe``: whether the row's account is one that no rule may touch.

    The accounts are a list, or a DataFrame of any size with the ids in its first
    column. Repeated ids count once.
    """
    if not isinstance(protected, DataFrame):
        ids = list(protected)
        if len(ids) <= INLINE_IDS:
            return df.withColumn("_safe", C(key).isin(ids) if ids else F.lit(False))
        kind = df.schema[key].dataType.simpleString()
        protected = df.sparkSession.createDataFrame([(i,) for i in ids], f"id {kind}")
    safe = protected.select(C(protected.columns[0]).alias("_id")).distinct()
    joined = df.join(safe, C(key) == C("_id"), "left")
    return joined.withColumn("_safe", C("_id").isNotNull()).drop("_id")


# Billing --------------------------------------------------------------------


def billing(t: Tables) -> DataFrame:
    """One row per live customer with its live subscription, if any."""
    customers = live(t.stripe_customers).select("user_id", "customer_id")
    subscriptions = live(t.stripe_subscriptions).select(
        "customer_id", C("status").alias("subscription_status"), *SUBSCRIPTION_COLUMNS
    )
    return customers.join(subscriptions, "customer_id", "left")


def billing_where_live(t: Tables) -> DataFrame:
    """As ``billing``, but a customer whose subscription is deleted vanishes."""
    customers = live(t.stripe_customers).select("user_id", "customer_id")
    subscriptions = t.stripe_subscriptions.select(
        "customer_id",
        C("status").alias("subscription_status"),
        *SUBSCRIPTION_COLUMNS,
        "deleted_at",
    )
    return live(customers.join(subscriptions, "customer_id", "left")).drop("deleted_at")


def paying_users(t: Tables) -> DataFrame:
    """Users with a live customer and a live subscription that pays."""
    payers = live(t.stripe_subscriptions).filter(C("status").isin(*PAYING_STATUSES))
    return (
        live(t.stripe_customers)
        .select("user_id", "customer_id")
        .join(payers.select("customer_id"), "customer_id")
        .select("user_id")
        .distinct()
    )


def user_subscriptions(t: Tables) -> DataFrame:
    return billing_where_live(t).select(
        "customer_id",
        "subscription_status",
        *SUBSCRIPTION_COLUMNS,
        product_name(C("price_id")).alias("product_name"),
    )


def subscription_details(t: Tables) -> DataFrame:
    """Every live customer, with defaults in place of a missing subscription."""
    return billing(t).select(
        "user_id",
        "customer_id",
        F.coalesce("subscription_status", F.lit("not_started")).alias("subscription_status"),
        *[
            F.coalesce(c, F.lit(False)).alias(c) if c == "cancel_at_period_end" else C(c)
            for c in SUBSCRIPTION_COLUMNS
        ],
        product_name(C("price_id")).alias("product_name"),
    )


def user_orders(t: Tables) -> DataFrame:
    """Live customers with their live orders; a customer who never ordered
    keeps one empty row, one whose orders are all deleted has none.

    A plain outer join would pin all orders of a hot customer to one task,
    since its order side may not be split. So the matches come from an inner
    join, whose oversized partitions adaptive execution can split, and the
    customers without orders from an anti join against distinct keys, which
    are reduced before they are shuffled.
    """
    customers = live(t.stripe_customers).select("customer_id")
    details = {
        "order_id": C("id"),
        "checkout_session_id": C("checkout_session_id"),
        "payment_intent_id": C("payment_intent_id"),
        "amount_subtotal": C("amount_subtotal"),
        "amount_total": C("amount_total"),
        "currency": C("currency"),
        "payment_status": C("payment_status"),
        "order_status": C("status"),
        "order_date": C("created_at"),
    }
    orders = live(t.stripe_orders).select(
        "customer_id", *[e.alias(n) for n, e in details.items()]
    )
    matched = customers.join(orders, "customer_id")
    ordered = t.stripe_orders.select("customer_id").distinct()
    never = customers.join(ordered, "customer_id", "left_anti")
    return matched.unionByName(never, allowMissingColumns=True)


def customer_nested(t: Tables) -> DataFrame:
    """Live customers with their subscription rows as an array.

    A customer has at most one subscription row, so no grouping is needed.
    """
    row = F.struct("subscription_id", "status", "price_id", "current_period_end")
    subscriptions = t.stripe_subscriptions.select("customer_id", row.alias("row"))
    return (
        live(t.stripe_customers)
        .select("customer_id")
        .join(subscriptions, "customer_id", "left")
        .select(
            "customer_id",
            F.when(C("row").isNull(), F.array())
            .otherwise(F.array("row"))
            .alias("subscriptions"),
        )
    )


def current_plan(t: Tables) -> DataFrame:
    """One row per live customer and product: is it the plan in use?"""
    paying = C("subscription_status").isin(*PAYING_STATUSES)
    return (
        billing_where_live(t)
        .select(
            "user_id",
            C("price_id").alias("held"),
            "subscription_status",
            F.explode(product_structs()).alias("product"),
        )
        .select(
            "user_id",
            C("product.price_id").alias("price_id"),
            F.coalesce((C("held") == C("product.price_id")) & paying, F.lit(False)).alias(
                "is_current"
            ),
        )
    )


# What each subscription status is called on the status card.
SUBSCRIPTION_LABELS = {
    "active": "ACTIVE SUBSCRIPTION",
    "trialing": "TRIAL PERIOD",
    "past_due": "PAYMENT OVERDUE",
    "canceled": "CANCELED",
}
NO_SUBSCRIPTION_LABEL = "NO SUBSCRIPTION"
OTHER_SUBSCRIPTION_LABEL = "SUBSCRIPTION STATUS"


def subscription_label(t: Tables) -> DataFrame:
    """The status card of every user."""
    held = billing_where_live(t).select(
        C("user_id"),
        C("subscription_status").alias("status"),
        "current_period_end",
        F.lit(True).alias("has_row"),
    )
    named = F.lit(OTHER_SUBSCRIPTION_LABEL)
    for status, name in SUBSCRIPTION_LABELS.items():
        named = F.when(C("status") == status, F.lit(name)).otherwise(named)
    renews = clock.date_text(clock.from_epoch(C("current_period_end")))
    none = C("has_row").isNull() | (C("status") == "not_started")
    return t.users.select("user_id").join(held, "user_id", "left").select(
        "user_id",
        F.when(none, F.lit(NO_SUBSCRIPTION_LABEL)).otherwise(named).alias("label"),
        F.when(C("status") == "active", renews).alias("renews_on"),
    )


# Access ---------------------------------------------------------------------


def trial_columns(as_of: Column, days_mode: str = "floor") -> list[Column]:
    rounding = "nearest" if days_mode == "floor" else "floor"
    end = C("trial_end_date")
    return [
        clock.seconds_remaining(end, as_of, rounding).alias("seconds_remaining"),
        clock.days_remaining(end, as_of, days_mode).alias("days_remaining"),
    ]


def trial_info(t: Tables, as_of: clock.Instant, days_mode: str = "floor") -> DataFrame:
    """Trials with the time left.

    ``days_mode='floor'`` counts whole days and rounds seconds; ``'ceil'``
    counts started days and cuts fractions of a second.
    """
    return t.user_trials.select(
        "user_id",
        "trial_start_date",
        "trial_end_date",
        "trial_status",
        "deletion_scheduled_at",
        *trial_columns(clock.instant(as_of), days_mode),
    )


def _access_type(trial_is_live: Column) -> Column:
    status = C("subscription_status")
    return (
        F.when(status == "active", F.lit("paid_subscription"))
        .when(status == "trialing", F.lit("stripe_trial"))
        .when(trial_is_live, F.lit("free_trial"))
        .otherwise(F.lit("no_access"))
    )


def _with_access(df: DataFrame, trial_is_live: Column, *after: str | Column) -> DataFrame:
    """Access type, and access itself, which is any type but the last."""
    typed = df.withColumn("access_type", _access_type(trial_is_live))
    return typed.withColumn("has_access", C("access_type") != "no_access").select(
        "user_id",
        "trial_start_date",
        "trial_end_date",
        "trial_status",
        "deletion_scheduled_at",
        "subscription_status",
        "subscription_id",
        "price_id",
        "current_period_end",
        "has_access",
        "access_type",
        *after,
    )


def trial_is_live(as_of: Column) -> Column:
    return (C("trial_status") == "active") & (C("trial_end_date") > as_of)


_HELD = ("user_id", "subscription_status", "subscription_id", "price_id", "current_period_end")


def access_status(t: Tables, as_of: clock.Instant, days_mode: str = "floor") -> DataFrame:
    """Who has access, why, and for how long: one row per trial."""
    now = clock.instant(as_of)
    trials = t.user_trials.select(
        "user_id", "trial_start_date", "trial_end_date", "trial_status", "deletion_scheduled_at"
    )
    # Customer and subscription are matched first: the subscription side is
    # narrow there, and the result meets the trials on the one key left.
    joined = trials.join(billing(t).select(*_HELD), "user_id", "left")
    return _with_access(joined, trial_is_live(now), *trial_columns(now, days_mode))


def access_from_views(t: Tables, as_of: clock.Instant) -> DataFrame:
    """Access put together from the trial and subscription views.

    Unlike ``access_status``, a trial in its last 24 hours no longer counts.
    """
    info = trial_info(t, as_of)
    joined = info.join(billing_where_live(t).select(*_HELD), "user_id", "left")
    still = (C("trial_status") == "active") & (C("days_remaining") > 0)
    return _with_access(joined, still, "seconds_remaining", "days_remaining")


def access_level(t: Tables, as_of: clock.Instant) -> DataFrame:
    return access_status(t, as_of).select(
        "user_id",
        "has_access",
        "access_type",
        F.coalesce("subscription_status", F.lit("none")).alias("subscription_status"),
        "trial_status",
        "days_remaining",
    )


def access_flags(t: Tables, as_of: clock.Instant) -> DataFrame:
    """Every yes/no question that the front end asks about a user."""
    trial, kind = C("trial_status"), C("access_type")
    running, over = C("days_remaining") > 0, C("days_remaining") == 0
    flags = {
        "is_trial_active": (trial == "active") & running,
        "is_trial_expired": (trial == "expired") | ((trial == "active") & over),
        "is_scheduled_for_deletion": trial == "scheduled_for_deletion",
        "has_converted_to_paid": trial == "converted_to_paid",
        "has_access": C("has_access"),
        "is_paid_user": kind == "paid_subscription",
        "is_trialing": kind == "stripe_trial",
        "is_free_trialing": kind == "free_trial",
        "is_protected": kind.isin("paid_subscription", "stripe_trial")
        | (trial == "converted_to_paid"),
        "has_active_subscription": C("subscription_status") == "active",
        "is_subscription_trialing": C("subscription_status") == "trialing",
        "is_past_due": C("subscription_status") == "past_due",
        "is_canceled": C("subscription_status") == "canceled",
    }
    return access_status(t, as_of).select(
        "user_id",
        *[F.coalesce(v, F.lit(False)).alias(n) for n, v in flags.items()],
        text.label(kind).alias("access_label"),
    )


def trial_countdown(
    t: Tables, as_of: clock.Instant, protected_user_ids: Protected
) -> DataFrame:
    """Countdown to the end of the trial and the banners shown with it."""
    now = clock.instant(as_of)
    users = t.users.select("user_id", C("created_at").alias("joined_at"))
    state = t.user_account_state.select("user_id", "account_status", "trial_days_remaining")
    base = (
        access_status(t, now)
        .select("user_id", "trial_status", "trial_end_date", "subscription_status", "days_remaining")
        .join(users, "user_id", "left")
        .join(state, "user_id", "left")
    )
    left = clock.countdown_parts(C("trial_end_date"), now)
    d, h, m = (C(n).cast("string") for n in ("days", "hours", "minutes"))
    clock_text = (
        F.when(C("trial_end_date") <= now, F.lit("Expired"))
        .when(C("days") > 0, F.concat(d, F.lit("d "), h, F.lit("h "), m, F.lit("m")))
        .when(C("hours") > 0, F.concat(h, F.lit("h "), m, F.lit("m")))
        .otherwise(F.concat(m, F.lit("m")))
    )
    trial = C("trial_status")
    banner = (
        F.when(C("subscription_status") == "active", F.lit("premium_active"))
        .when(trial == "scheduled_for_deletion", F.lit("deletion_scheduled"))
        .when(
            (trial == "expired") | ((trial == "active") & (C("days_remaining") == 0)),
            F.lit("trial_expired"),
        )
        .when((trial == "active") & (C("days_remaining") <= 1), F.lit("trial_ending_soon"))
        .when(trial == "active", F.lit("trial_active"))
        .otherwise(F.lit("none"))
    )
    deletes_at = C("joined_at") + clock.days(TRIAL_DAYS)
    deletes_in = clock.countdown_parts(deletes_at, now)["days"]
    counting = (C("account_status") == "trial_active") & (C("trial_days_remaining") > 0)
    deletion = (
        F.when(C("_safe"), F.lit("exempt"))
        .when(~F.coalesce(counting, F.lit(False)), F.lit("none"))
        .when(deletes_at <= now, F.lit("expired"))
        .when(deletes_in == 0, F.lit("urgent"))
        .when(deletes_in == 1, F.lit("soon"))
        .otherwise(F.lit("counting"))
    )
    return flag_protected(base, protected_user_ids).withColumns(left).select(
        "user_id",
        *left,
        clock_text.alias("text"),
        banner.alias("banner"),
        deletion.alias("deletion_banner"),
    )


def protection_status(t: Tables) -> DataFrame:
    """Who may not be deleted, and why: one row per user."""
    # The four reasons, in the order in which they apply.
    status, trial = C("subscription_status"), C("trial_status")
    reason = (
        F.when(status == "active", F.lit("Active paid subscription"))
        .when(status == "trialing", F.lit("Stripe trial period"))
        .when(trial == "converted_to_paid", F.lit("Previously converted to paid"))
        .otherwise(F.lit("No protection - eligible for deletion"))
    )
    safe = status.isin(*PAYING_STATUSES) | (trial == "converted_to_paid")
    return (
        t.users.select("user_id", "email")
        .join(t.user_trials.select("user_id", "trial_status"), "user_id", "left")
        .join(billing(t).select("user_id", "subscription_status"), "user_id", "left")
        .select(
            "user_id",
            "email",
            F.coalesce(safe, F.lit(False)).alias("is_protected"),
            reason.alias("protection_reason"),
            "trial_status",
            F.coalesce(status, F.lit("none")).alias("subscription_status"),
        )
    )


# Overviews ------------------------------------------------------------------


def user_overview(t: Tables) -> DataFrame:
    """Profile, state, trial, billing and linked account in one row per profile."""
    profiles = t.user_profiles.select(
        C("id").alias("user_id"),
        "email",
        "full_name",
        "company",
        C("created_at").alias("user_created_at"),
        "last_login_at",
    )
    state = t.user_account_state.select(
        "user_id",
        "account_status",
        "has_access",
        "access_level",
        "trial_days_remaining",
        "last_activity_at",
    )
    trials = t.user_trials.select("user_id", "trial_start_date", "trial_end_date", "trial_status")
    bills = billing(t).select(
        "user_id",
        C("customer_id").alias("stripe_customer_id"),
        C("subscription_id").alias("stripe_subscription_id"),
        C("subscription_status").alias("stripe_status"),
        "current_period_end",
        "price_id",
    )
    links = t.linked_accounts.select(
        "user_id",
        "external_user_id",
        "external_email",
        C("account_status").alias("external_status"),
        C("last_sync_at").alias("external_last_sync"),
    )
    out = profiles
    for part in (state, trials, bills, links):
        out = out.join(part, "user_id", "left")
    return out


def overview_access(t: Tables) -> DataFrame:
    """The overview in the shape of the access view."""
    level = C("access_level")
    return user_overview(t).select(
        "user_id",
        "has_access",
        F.when(level == "pro", F.lit("paid_subscription"))
        .when(level == "trial", F.lit("free_trial"))
        .otherwise(F.lit("no_access"))
        .alias("access_type"),
        (C("trial_days_remaining").cast("long") * 86_400).alias("seconds_remaining"),
        C("trial_days_remaining").alias("days_remaining"),
    )


def state_flags(t: Tables) -> DataFrame:
    """The stored account state with the defaults of a missing one."""
    level = C("access_level")
    return user_overview(t).select(
        "user_id",
        F.coalesce("has_access", F.lit(False)).alias("has_access"),
        text.first_filled(level, F.lit("trial")).alias("access_level"),
        F.coalesce(level == "pro", F.lit(False)).alias("is_paid_user"),
        F.coalesce(level == "trial", F.lit(False)).alias("is_trial_user"),
        F.coalesce("trial_days_remaining", F.lit(0)).alias("days_remaining"),
    )


def admin_overview(t: Tables) -> DataFrame:
    profiles = t.user_profiles.select(
        C("id").alias("user_id"), "email", "full_name", "company", "created_at", "is_active"
    )
    state = t.user_account_state.select(
        "user_id",
        "account_status",
        "has_access",
        "access_level",
        "trial_days_remaining",
        "last_activity_at",
    )
    bills = live(t.stripe_customers).select(
        "user_id", "customer_id", C("last_sync_at").alias("stripe_last_sync")
    )
    links = t.linked_accounts.select(
        "user_id", "external_user_id", C("last_sync_at").alias("external_last_sync")
    )
    joined = (
        profiles.join(state, "user_id", "left")
        .join(bills, "user_id", "left")
        .join(links, "user_id", "left")
    )
    return joined.select(
        "user_id",
        "email",
        "full_name",
        "company",
        "created_at",
        "is_active",
        "account_status",
        "has_access",
        "access_level",
        "trial_days_remaining",
        C("customer_id").isNotNull().alias("has_stripe_account"),
        C("external_user_id").isNotNull().alias("has_linked_account"),
        "last_activity_at",
        "external_last_sync",
        "stripe_last_sync",
    )
