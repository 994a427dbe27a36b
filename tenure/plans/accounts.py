"""Account state, provisioning, and the checks against trial abuse.

Batches given to the keyed jobs have one row per key; see
``operators.keyed.extreme_per_key`` for reducing them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions import clock, text
from tenure.model import SCHEMAS, TRIAL_DAYS, Tables
from tenure.operators.keyed import apply_update, insert_if_absent, upsert
from tenure.plans.access import Protected, billing_where_live, flag_protected

C = F.col

# Fixed values ---------------------------------------------------------------
# Account status, access and access level that follow from the subscription's
# status, when it decides.
STATE_BY_SUBSCRIPTION = {
    "active": ("subscription_active", True, "pro"),
    "trialing": ("subscription_trialing", True, "pro"),
    "past_due": ("subscription_past_due", False, "suspended"),
    "canceled": ("subscription_canceled", False, "trial"),
}
STATE_TRIAL_LIVE = ("trial_active", True, "trial")
STATE_TRIAL_OVER = ("trial_expired", False, "suspended")

MESSAGE_RETURNING = "Welcome back! Please subscribe to continue using our service."
MESSAGE_NEW = "Welcome! Your 7-day free trial has started."
SUMMARY_NEW = "Welcome! You're eligible for a 7-day free trial."
SUMMARY_RETURNING = (
    "You've already used your free trial. Please subscribe to continue using our service."
)
DEFAULT_DELETION_REASON = "trial_expired"
# ----------------------------------------------------------------------------


def _state(values: tuple[str, bool, str]) -> Column:
    status, access, level = values
    return F.struct(
        F.lit(status).alias("account_status"),
        F.lit(access).alias("has_access"),
        F.lit(level).alias("access_level"),
    )


# Account state --------------------------------------------------------------


def account_state_sync(t: Tables, as_of: clock.Instant) -> DataFrame:
    """Recompute every stored account state from its sources: the next
    ``user_account_state`` snapshot."""
    now = clock.instant(as_of)
    trials = t.user_trials.select(
        "user_id", "trial_status", C("trial_end_date").alias("_trial_end")
    )
    bills = billing_where_live(t).select(
        "user_id",
        C("customer_id").alias("_customer"),
        C("subscription_id").alias("_subscription"),
        C("subscription_status").alias("_status"),
        C("current_period_end").alias("_period_end"),
    )
    links = t.linked_accounts.select(
        "user_id", C("external_user_id").alias("_external"), C("account_status").alias("_link")
    )
    live_trial = (C("trial_status") == "active") & (C("_trial_end") > now)
    decided = F.when(live_trial, _state(STATE_TRIAL_LIVE)).otherwise(_state(STATE_TRIAL_OVER))
    for status, values in STATE_BY_SUBSCRIPTION.items():
        decided = F.when(C("_status") == status, _state(values)).otherwise(decided)
    new = {
        "account_status": C("_new.account_status"),
        "has_access": C("_new.has_access"),
        "access_level": C("_new.access_level"),
        "stripe_customer_id": C("_customer"),
        "stripe_subscription_id": C("_subscription"),
        "subscription_status": C("_status"),
        "current_period_end": clock.from_epoch(C("_period_end")),
        "external_user_id": C("_external"),
        "external_status": C("_link"),
        "trial_days_remaining": clock.days_remaining(C("_trial_end"), now),
        "updated_at": now,
        "last_activity_at": now,
    }
    joined = (
        t.user_account_state.join(trials, "user_id", "left")
        .join(bills, "user_id", "left")
        .join(links, "user_id", "left")
        .withColumn("_new", decided)
    )
    return joined.select(*[new.get(c, C(c)).alias(c) for c in t.user_account_state.columns])


def state_sync_report(t: Tables, as_of: clock.Instant) -> DataFrame:
    """How a sync of all active profiles comes out, per resulting state.

    The row with ``is_total`` counts everything. A profile without a stored
    state is considered but not updated.
    """
    active = t.user_profiles.filter(C("is_active")).select(C("id").alias("user_id"))
    synced = account_state_sync(t, as_of).select(
        "user_id", "account_status", "access_level", "has_access", F.lit(1).alias("stored")
    )
    keys = [C("account_status"), C("access_level"), C("has_access")]
    return (
        active.join(synced, "user_id", "left")
        .groupingSets([keys, []], *keys)
        .agg(
            (F.grouping_id() > 0).alias("is_total"),
            F.count(F.lit(1)).alias("profiles_considered"),
            F.count("stored").alias("states_updated"),
        )
    )


def system_metrics(t: Tables, as_of: clock.Instant) -> DataFrame:
    """Five counts in one row.

    The rows to count are tagged and unioned, and counted before they meet: one
    stage over all tables, and no cross join of single-row results.
    """
    counted = {
        "total_users": t.user_profiles,
        "active_trials": t.user_trials.filter(C("trial_status") == "active"),
        "active_subscriptions": t.stripe_subscriptions.filter(C("status") == "active"),
        "linked_accounts": t.linked_accounts,
        "users_with_access": t.user_account_state.filter(C("has_access")),
    }
    tagged = [df.select(F.lit(name).alias("metric")) for name, df in counted.items()]
    return reduce(DataFrame.unionByName, tagged).agg(
        *[F.count_if(C("metric") == name).alias(name) for name in counted],
        F.lit(clock.instant(as_of)).alias("generated_at"),
    )


# Provisioning ---------------------------------------------------------------


def profile_upsert(t: Tables, batch: DataFrame, as_of: clock.Instant) -> DataFrame:
    """The next profiles after a batch of (user_id, email, full_name).

    A known profile keeps its name when the batch brings none.
    """
    now = clock.instant(as_of)
    source = batch.select(C("user_id").alias("id"), "email", "full_name")
    return upsert(
        t.user_profiles,
        source,
        "id",
        update={
            "email": C("new.email"),
            "full_name": F.coalesce("new.full_name", "old.full_name"),
            "updated_at": now,
        },
        insert={
            "email": C("new.email"),
            "full_name": C("new.full_name"),
            "created_at": now,
            "updated_at": now,
            "is_active": F.lit(True),
            "metadata": F.lit("{}"),
        },
    )


def new_states(users: DataFrame, now: Column, trial_days: int = TRIAL_DAYS) -> DataFrame:
    """Initial account states, one per given user."""
    return users.select(
        "user_id",
        F.lit("trial_active").alias("account_status"),
        F.lit(True).alias("has_access"),
        F.lit("trial").alias("access_level"),
        now.alias("trial_start_date"),
        (now + clock.days(trial_days)).alias("trial_end_date"),
        F.lit(trial_days).alias("trial_days_remaining"),
        F.lit("active").alias("external_status"),
        now.alias("created_at"),
        now.alias("updated_at"),
        now.alias("last_activity_at"),
        F.lit("{}").alias("admin_flags"),
    )


def state_provisioning(t: Tables, batch: DataFrame, as_of: clock.Instant) -> DataFrame:
    """The next states: users of the batch without one get the initial state."""
    return insert_if_absent(
        t.user_account_state, new_states(batch, clock.instant(as_of)), "user_id"
    )


def profile_backfill(t: Tables, as_of: clock.Instant) -> DataFrame:
    """The next profiles: users without one get it from their sign-in record."""
    now = clock.instant(as_of)
    missing = t.users.select(
        C("user_id").alias("id"),
        "email",
        "created_at",
        now.alias("updated_at"),
        F.lit(True).alias("is_active"),
        F.lit("{}").alias("metadata"),
    )
    return insert_if_absent(t.user_profiles, missing, "id")


def linked_account_upsert(t: Tables, batch: DataFrame, as_of: clock.Instant) -> DataFrame:
    """The next linked accounts after (user_id, external_user_id, external_email)."""
    now = clock.instant(as_of)
    sets = {
        "external_user_id": C("new.external_user_id"),
        "external_email": C("new.external_email"),
        "updated_at": now,
        "last_sync_at": now,
    }
    return upsert(
        t.linked_accounts,
        batch.select("user_id", "external_user_id", "external_email"),
        "user_id",
        update=sets,
        insert={
            **sets,
            "id": F.xxhash64("new.user_id"),
            "account_status": F.lit("active"),
            "created_at": now,
            "sync_errors": F.lit("[]"),
        },
    )


def linked_state_update(t: Tables, batch: DataFrame, as_of: clock.Instant) -> DataFrame:
    """The next states after linking."""
    sets = {
        "external_user_id": C("new.external_user_id"),
        "external_status": F.lit("active"),
        "updated_at": clock.instant(as_of),
    }
    source = batch.select("user_id", "external_user_id")
    return apply_update(t.user_account_state, source, "user_id", sets)


def customer_link_update(t: Tables, batch: DataFrame, as_of: clock.Instant) -> DataFrame:
    """The next customers after (user_id, customer_id, email): the email changes
    only where user and customer both agree."""
    now = clock.instant(as_of)
    agrees = C("new.customer_id") == C("old.customer_id")
    return apply_update(
        t.stripe_customers,
        batch.select("user_id", "customer_id", "email"),
        "user_id",
        {
            "stripe_customer_email": F.when(agrees, C("new.email")).otherwise(
                C("old.stripe_customer_email")
            ),
            "last_sync_at": F.when(agrees, now).otherwise(C("old.last_sync_at")),
            "updated_at": F.when(agrees, now).otherwise(C("old.updated_at")),
        },
    )


def customer_link_state(t: Tables, batch: DataFrame, as_of: clock.Instant) -> DataFrame:
    """The next states: the customer id is set by user alone."""
    return apply_update(
        t.user_account_state,
        batch.select("user_id", "customer_id"),
        "user_id",
        {"stripe_customer_id": C("new.customer_id"), "updated_at": clock.instant(as_of)},
    )


# Deletion history and re-signup ---------------------------------------------


def _history_summary(t: Tables) -> DataFrame:
    return t.deleted_account_history.select(
        "email",
        C("trial_used").alias("has_used_trial"),
        C("requires_immediate_subscription").alias("requires_subscription"),
        "ever_subscribed",
        "deletion_reason",
        C("account_deleted_at").alias("deleted_at"),
    )


def email_trial_history(t: Tables, emails: DataFrame) -> DataFrame:
    """What the deletion history says about each given email that it knows."""
    return _history_summary(t).join(emails.select("email").distinct(), "email", "left_semi")


def returning_users(t: Tables, emails: DataFrame) -> DataFrame:
    """The welcome summary of each given email: new or returning."""
    used = F.coalesce(C("has_used_trial"), F.lit(False))
    needs = used & F.coalesce(C("requires_subscription"), F.lit(False))
    asked = emails.select("email").distinct()
    return asked.join(_history_summary(t), "email", "left").select(
        "email",
        used.alias("is_returning_user"),
        (used & F.coalesce(C("ever_subscribed"), F.lit(False))).alias("ever_subscribed"),
        F.when(used, clock.date_text(C("deleted_at"))).alias("last_deletion"),
        F.when(used, text.spaced_once(C("deletion_reason"))).alias("deletion_reason"),
        needs.alias("subscription_required"),
        F.when(~used, F.lit(SUMMARY_NEW)).when(needs, F.lit(SUMMARY_RETURNING)).alias("message"),
    )


def deletion_history_record(t: Tables, requests: DataFrame, as_of: clock.Instant) -> DataFrame:
    """The next history after deletions of (user_id, email[, reason]).

    An email already in the history only gets a new date and reason.
    """
    reason = C("reason") if "reason" in requests.columns else F.lit(DEFAULT_DELETION_REASON)
    trials = t.user_trials.select("user_id", "trial_start_date", "trial_end_date", "trial_status")
    bills = billing_where_live(t).select("user_id", "subscription_status")
    source = (
        requests.select("user_id", "email", reason.alias("reason"))
        .join(trials, "user_id", "left")
        .join(bills, "user_id", "left")
    )
    return record_deletions(t.deleted_account_history, source, as_of)


def record_deletions(history: DataFrame, source: DataFrame, as_of: clock.Instant) -> DataFrame:
    """The next history after deletions of (user_id, email, reason) whose trial and
    last subscription_status are known."""
    now = clock.instant(as_of)
    status = C("new.subscription_status")
    return upsert(
        history,
        source,
        "email",
        update={"account_deleted_at": now, "deletion_reason": C("new.reason")},
        insert={
            "id": text.stable_id(C("new.user_id"), C("new.email")),
            "original_user_id": C("new.user_id"),
            "trial_used": F.lit(True),
            "trial_start_date": C("new.trial_start_date"),
            "trial_end_date": C("new.trial_end_date"),
            "trial_completed": F.coalesce(
                C("new.trial_status") == "converted_to_paid", F.lit(False)
            ),
            "ever_subscribed": status.isNotNull(),
            "last_subscription_status": status,
            "subscription_cancelled_date": F.when(status == "canceled", now),
            "account_deleted_at": now,
            "deletion_reason": C("new.reason"),
            "can_get_new_trial": F.lit(False),
            "requires_immediate_subscription": F.lit(True),
            "created_at": now,
            "updated_at": now,
        },
    )


def deletion_history_listing(t: Tables) -> DataFrame:
    """The history, newest deletion first.

    The unique email breaks ties, so that a date shared by very many rows can
    still be split between the sorting tasks.
    """
    return t.deleted_account_history.orderBy(C("account_deleted_at").desc(), C("email"))


def safe_delete_outcomes(
    t: Tables, requests: DataFrame, protected: Protected
) -> DataFrame:
    """What becomes of each deletion request: protected, not_found or recorded."""
    asked = requests.select("user_id").distinct()
    users = t.users.select("user_id", "email")
    outcome = (
        F.when(C("_safe"), F.lit("protected"))
        .when(C("email").isNull(), F.lit("not_found"))
        .otherwise(F.lit("recorded"))
    )
    judged = flag_protected(asked.join(users, "user_id", "left"), protected)
    return judged.select("user_id", "email", outcome.alias("outcome"))


def safe_deletes(
    t: Tables, requests: DataFrame, as_of: clock.Instant, protected: Protected
) -> DataFrame:
    """The next history after the requests that pass the safety checks."""
    passed = safe_delete_outcomes(t, requests, protected).filter(C("outcome") == "recorded")
    return deletion_history_record(t, passed.select("user_id", "email"), as_of)


def _known_emails(t: Tables, strict_record: bool) -> DataFrame:
    history = t.deleted_account_history
    if strict_record:
        complete = reduce(
            Column.__and__, [C(f.name).isNotNull() for f in SCHEMAS["deleted_account_history"]]
        )
        history = history.filter(complete)
    return history.select("email", F.lit(True).alias("_known"))


def resignup_decisions(t: Tables, signups: DataFrame, strict_record: bool = False) -> DataFrame:
    """Whether each signup (user_id, email) comes back after using a trial.

    An email counts as known when the history has a row for it; with
    ``strict_record`` only when that row has no empty column.
    """
    known = C("_known").isNotNull()
    joined = signups.select("user_id", "email").join(
        _known_emails(t, strict_record), "email", "left"
    )
    return joined.select(
        "user_id",
        known.alias("is_returning_user"),
        known.alias("requires_subscription"),
        (~known).alias("trial_allowed"),
        F.when(known, F.lit(MESSAGE_RETURNING)).otherwise(F.lit(MESSAGE_NEW)).alias("message"),
    )


def signup_provisioning(
    t: Tables, signups: DataFrame, trial_days: int = TRIAL_DAYS, strict_record: bool = False
) -> DataFrame:
    """What the new accounts look like after a batch of signups (user_id,
    email, full_name, created_at), each judged at its own time of signup.

    Rows that exist already are kept, so a replayed batch changes nothing.
    """
    at = C("created_at")
    known = C("_known").isNotNull()
    over = at + clock.days(trial_days)
    had_profile = t.user_profiles.select(C("id").alias("user_id"), C("full_name").alias("_name"))
    had_state = t.user_account_state.select(
        "user_id",
        C("account_status").alias("_status"),
        C("has_access").alias("_access"),
        C("access_level").alias("_level"),
        C("trial_days_remaining").alias("_days"),
    )
    had_trial = t.user_trials.select(
        "user_id",
        C("trial_start_date").alias("_start"),
        C("trial_end_date").alias("_end"),
        C("trial_status").alias("_trial"),
        C("deletion_scheduled_at").alias("_scheduled"),
    )
    joined = (
        signups.select("user_id", "email", "full_name", "created_at")
        .join(had_profile, "user_id", "left")
        .join(had_state, "user_id", "left")
        .join(had_trial, "user_id", "left")
        .join(_known_emails(t, strict_record), "email", "left")
    )
    status, access, level = STATE_TRIAL_LIVE
    no_status, no_access, no_level = STATE_TRIAL_OVER

    def settle(returning: Column, old: str, fresh: Column) -> Column:
        return F.when(known, returning).otherwise(F.coalesce(C(old), fresh))

    return joined.select(
        "user_id",
        "email",
        F.coalesce("full_name", "_name").alias("full_name"),
        settle(F.lit(no_status), "_status", F.lit(status)).alias("account_status"),
        settle(F.lit(no_access), "_access", F.lit(access)).alias("has_access"),
        settle(F.lit(no_level), "_level", F.lit(level)).alias("access_level"),
        settle(F.lit(0), "_days", F.lit(trial_days)).alias("trial_days_remaining"),
        F.coalesce(C("_start"), at).alias("trial_start_date"),
        settle(at, "_end", over).alias("trial_end_date"),
        settle(F.lit("expired"), "_trial", F.lit("active")).alias("trial_status"),
        F.when(~known, C("_scheduled")).alias("deletion_scheduled_at"),
        known.alias("is_returning_user"),
        at.alias("created_at"),
    )


def apply_signups(
    t: Tables, signups: DataFrame, trial_days: int = TRIAL_DAYS, strict_record: bool = False
) -> Tables:
    """The next profiles, states and trials after a batch of signups."""
    made = signup_provisioning(t, signups, trial_days, strict_record)
    at = C("new.created_at")
    touched = {"updated_at": at}
    state_sets = {
        n: C(f"new.{n}")
        for n in ("account_status", "has_access", "access_level", "trial_days_remaining")
    }
    trial_sets = {
        n: C(f"new.{n}") for n in ("trial_status", "trial_end_date", "deletion_scheduled_at")
    }
    returning = C("new.is_returning_user")

    def only_returning(sets: dict[str, Column]) -> dict[str, Column]:
        return {
            n: F.when(returning, v).otherwise(C(f"old.{n}")) for n, v in {**sets, **touched}.items()
        }

    profiles = upsert(
        t.user_profiles,
        made.withColumnRenamed("user_id", "id"),
        "id",
        update={"email": C("new.email"), "full_name": C("new.full_name"), **touched},
        insert={
            "email": C("new.email"),
            "full_name": C("new.full_name"),
            "is_active": F.lit(True),
            "metadata": F.lit("{}"),
            "created_at": at,
            **touched,
        },
    )
    states = upsert(
        t.user_account_state,
        made,
        "user_id",
        update=only_returning(state_sets),
        insert={
            **state_sets,
            "trial_start_date": at,
            "trial_end_date": at + clock.days(trial_days),
            "external_status": F.lit("active"),
            "admin_flags": F.lit("{}"),
            "created_at": at,
            "last_activity_at": at,
            **touched,
        },
    )
    trials = upsert(
        t.user_trials,
        made,
        "user_id",
        update=only_returning(trial_sets),
        insert={
            **trial_sets,
            "id": F.xxhash64("new.user_id"),
            "trial_start_date": C("new.trial_start_date"),
            "created_at": at,
            **touched,
        },
    )
    return t.replace(user_profiles=profiles, user_account_state=states, user_trials=trials)


def _history_match(restores: DataFrame, match_on: str) -> tuple[DataFrame, str]:
    column = {"user_id": "original_user_id", "email": "email"}[match_on]
    return restores.select(C(match_on).alias(column)).distinct(), column


def apply_restores(
    t: Tables, restores: DataFrame, as_of: clock.Instant, match_on: str = "user_id"
) -> Tables:
    """The next trials, states and history after users (user_id, customer_id,
    subscription_id[, email]) subscribe again.

    The history row is found by the user's old id, or by ``match_on='email'``,
    which also finds users who came back under a new id.
    """
    now = clock.instant(as_of)
    trials = apply_update(
        t.user_trials,
        restores.select("user_id"),
        "user_id",
        {
            "trial_status": F.lit("converted_to_paid"),
            "deletion_scheduled_at": F.lit(None),
            "updated_at": now,
        },
    )
    status, access, level = STATE_BY_SUBSCRIPTION["active"]
    states = apply_update(
        t.user_account_state,
        restores.select("user_id", "customer_id", "subscription_id"),
        "user_id",
        {
            "account_status": F.lit(status),
            "has_access": F.lit(access),
            "access_level": F.lit(level),
            "stripe_customer_id": C("new.customer_id"),
            "stripe_subscription_id": C("new.subscription_id"),
            "updated_at": now,
        },
    )
    matches, column = _history_match(restores, match_on)
    history = apply_update(
        t.deleted_account_history,
        matches,
        column,
        {
            "ever_subscribed": F.lit(True),
            "last_subscription_status": F.lit("active"),
            "updated_at": now,
        },
    )
    return t.replace(user_trials=trials, user_account_state=states, deleted_account_history=history)


def restore_on_subscription(t: Tables, restores: DataFrame, match_on: str = "user_id") -> DataFrame:
    """Each restored user as ``apply_restores`` leaves the three tables."""
    status, _, level = STATE_BY_SUBSCRIPTION["active"]
    _, column = _history_match(restores, match_on)
    trials = t.user_trials.select("user_id", F.lit("converted_to_paid").alias("trial_status"))
    states = t.user_account_state.select(
        "user_id", F.lit(status).alias("account_status"), F.lit(level).alias("access_level")
    )
    history = (
        t.deleted_account_history.select(C(column).alias(match_on)).distinct()
    ).withColumn("_hit", F.lit(True))
    return (
        restores.select(*dict.fromkeys(("user_id", match_on)))
        .join(trials, "user_id", "left")
        .join(states, "user_id", "left")
        .join(history, match_on, "left")
        .select(
            "user_id",
            "trial_status",
            "account_status",
            "access_level",
            C("_hit").isNotNull().alias("history_updated"),
        )
    )
