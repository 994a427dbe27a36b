"""The trial state machine as one-pass snapshot transitions.

A transition is an ordered list of rules over the old row; the first rule that
holds decides the new row. Since no rule's result can satisfy a later rule at
the same ``as_of``, one pass gives what running the rules as successive updates
would give, with a single join and a single write.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions import clock
from tenure.model import GRACE_DAYS, PAYING_STATUSES, Tables
from tenure.operators.keyed import apply_update
from tenure.plans.access import Protected, billing_where_live, flag_protected, paying_users

C = F.col


class Rule(NamedTuple):
    when: Column
    status: str
    schedule: Column


def _paying() -> Column:
    return C("_paying")


def _convert(states: Column) -> Rule:
    return Rule(_paying() & states, "converted_to_paid", F.lit(None).cast("timestamp_ntz"))


def convert_rule() -> Rule:
    return _convert(C("trial_status") != "converted_to_paid")


def protect_rule() -> Rule:
    return _convert(C("trial_status").isin("expired", "scheduled_for_deletion"))


def _untouched() -> Column:
    return ~_paying() & ~C("_safe")


def expire_rule(now: Column, grace_days: int) -> Rule:
    due = (C("trial_status") == "active") & (C("trial_end_date") < now)
    return Rule(due & _untouched(), "expired", now + clock.days(grace_days))


def schedule_rule(now: Column) -> Rule:
    # A missing schedule never passes the comparison.
    due = (C("trial_status") == "expired") & (C("deletion_scheduled_at") < now)
    return Rule(
        due & _untouched(), "scheduled_for_deletion", C("deletion_scheduled_at")
    )


def with_paying(t: Tables, protected: Protected = ()) -> DataFrame:
    """The trials with ``_paying`` and ``_safe``; the join with payers that all rules share."""
    payers = paying_users(t).withColumn("_payer", F.lit(True))
    joined = t.user_trials.join(payers, "user_id", "left")
    flagged = joined.withColumn("_paying", C("_payer").isNotNull()).drop("_payer")
    return flag_protected(flagged, protected)


def transition(trials: DataFrame, now: Column, *rules: Rule) -> DataFrame:
    """The trials, flagged by ``with_paying``, after the first rule that holds."""
    status, schedule = C("trial_status"), C("deletion_scheduled_at")
    updated = C("updated_at")
    for rule in reversed(rules):
        status = F.when(rule.when, F.lit(rule.status)).otherwise(status)
        schedule = F.when(rule.when, rule.schedule).otherwise(schedule)
        updated = F.when(rule.when, now).otherwise(updated)
    new = {
        "trial_status": status,
        "deletion_scheduled_at": schedule,
        "updated_at": updated,
    }
    return trials.select(*[new.get(c, C(c)).alias(c) for c in trials.columns])


def _next_trials(
    t: Tables, now: Column, *rules: Rule, protected: Protected = ()
) -> DataFrame:
    return transition(with_paying(t, protected), now, *rules).drop("_paying", "_safe")


def convert_paying_trials(t: Tables, as_of: clock.Instant) -> DataFrame:
    return _next_trials(t, clock.instant(as_of), convert_rule())


def expire_trials(
    t: Tables, as_of: clock.Instant, protected: Protected, grace_days: int = GRACE_DAYS
) -> DataFrame:
    now = clock.instant(as_of)
    return _next_trials(t, now, expire_rule(now, grace_days), protected=protected)


def schedule_deletions(t: Tables, as_of: clock.Instant, protected: Protected) -> DataFrame:
    now = clock.instant(as_of)
    return _next_trials(t, now, schedule_rule(now), protected=protected)


def protect_paying(t: Tables, as_of: clock.Instant) -> DataFrame:
    return _next_trials(t, clock.instant(as_of), protect_rule())


def _sync_rules(now: Column, grace_days: int) -> tuple[Rule, ...]:
    return (
        convert_rule(),
        expire_rule(now, grace_days),
        schedule_rule(now),
    )


def sync_trials(
    t: Tables, as_of: clock.Instant, protected: Protected, grace_days: int = GRACE_DAYS
) -> DataFrame:
    """Convert, expire and schedule, in this order, in one pass."""
    now = clock.instant(as_of)
    return _next_trials(t, now, *_sync_rules(now, grace_days), protected=protected)


def _check_rules(now: Column, grace_days: int) -> tuple[Rule, ...]:
    return (protect_rule(), *_sync_rules(now, grace_days))


def check_expired_trials(
    t: Tables, as_of: clock.Instant, protected: Protected, grace_days: int = GRACE_DAYS
) -> DataFrame:
    """Protect payers first, then sync, in one pass."""
    now = clock.instant(as_of)
    return _next_trials(t, now, *_check_rules(now, grace_days), protected=protected)


def mark_converted(t: Tables, user_ids: DataFrame, as_of: clock.Instant) -> DataFrame:
    """Convert the trials of the given users, whatever their state."""
    sets = {
        "trial_status": F.lit("converted_to_paid"),
        "deletion_scheduled_at": F.lit(None),
        "updated_at": clock.instant(as_of),
    }
    return apply_update(t.user_trials, user_ids.select("user_id").distinct(), "user_id", sets)


# Deletion -------------------------------------------------------------------


def _deletable(now: Column, grace_days: int) -> Column:
    return (
        (C("trial_status") == "scheduled_for_deletion")
        & (C("trial_end_date") < now - clock.days(grace_days))
        & ~C("_safe")
    )


def deletion_candidates(
    t: Tables, as_of: clock.Instant, protected: Protected, grace_days: int = GRACE_DAYS
) -> DataFrame:
    """Scheduled trials, past their grace, of users neither paying nor protected."""
    flagged = flag_protected(t.user_trials, protected)
    due = flagged.filter(_deletable(clock.instant(as_of), grace_days))
    return (
        due.select("user_id", "trial_end_date")
        .join(paying_users(t), "user_id", "left_anti")
        .join(t.users.select("user_id", "email"), "user_id")
        .select("user_id", "email", "trial_end_date")
    )


def deletion_run(
    t: Tables,
    as_of: clock.Instant,
    protected: Protected,
    grace_days: int = GRACE_DAYS,
    recheck: Tables | None = None,
) -> DataFrame:
    """The scheduled cleanup: sync, list the candidates, check each once more.

    The sync and the list share one join with the payers. The second check is
    against ``recheck``, the tables as they are when the deletion starts; on
    the tables of the list itself it could not find anything new.
    """
    now = clock.instant(as_of)
    synced = transition(with_paying(t, protected), now, *_check_rules(now, grace_days))
    due = synced.filter(_deletable(now, grace_days) & ~_paying())
    listed = due.select("user_id", "trial_end_date").join(
        t.users.select("user_id", "email"), "user_id"
    )
    decision = F.lit("delete")
    if recheck is not None:
        payers = paying_users(recheck).withColumn("_pays_now", F.lit(True))
        listed = listed.join(payers, "user_id", "left")
        decision = F.when(C("_pays_now"), F.lit("protected")).otherwise(decision)
    return listed.select("user_id", "email", "trial_end_date", decision.alias("decision"))


def deletion_list(
    t: Tables,
    as_of: clock.Instant,
    protected: Protected,
    grace_days: int = GRACE_DAYS,
    recheck: Tables | None = None,
) -> DataFrame:
    """``deletion_run`` with what the history records of a user: the trial, and the last
    subscription, from the same join that tells who pays."""
    now = clock.instant(as_of)
    billed = billing_where_live(t).groupBy("user_id").agg(
        F.bool_or(C("subscription_status").isin(*PAYING_STATUSES)).alias("_pays"),
        F.max("subscription_status").alias("subscription_status"),
    )
    joined = t.user_trials.join(billed, "user_id", "left")
    flagged = joined.withColumn("_paying", F.coalesce("_pays", F.lit(False))).drop("_pays")
    synced = transition(flag_protected(flagged, protected), now, *_check_rules(now, grace_days))
    listed = synced.filter(_deletable(now, grace_days) & ~_paying()).select(
        "user_id", "trial_start_date", "trial_end_date", "trial_status", "subscription_status"
    )
    listed = listed.join(t.users.select("user_id", "email"), "user_id")
    decision = F.lit("delete")
    if recheck is not None:
        payers = paying_users(recheck).withColumn("_pays_now", F.lit(True))
        listed = listed.join(payers, "user_id", "left")
        decision = F.when(C("_pays_now"), F.lit("protected")).otherwise(decision)
    return listed.withColumn("decision", decision).drop("_pays_now")


def to_delete(run: DataFrame) -> DataFrame:
    """The users whom the second check leaves for deletion."""
    return run.filter(C("decision") == "delete").select("user_id", "email")


def deletion_run_report(run: DataFrame) -> DataFrame:
    """The counters of a ``deletion_run``."""
    return run.agg(
        F.count(F.lit(1)).alias("total_candidates"),
        F.count_if(C("decision") == "protected").alias("protected_users"),
        F.count_if(C("decision") == "delete").alias("processed"),
    )


def deletion_results(run: DataFrame, directory: DataFrame) -> DataFrame:
    """Per deleted user, whether the external directory has an account to
    delete as well; a missing one does not stop the deletion."""
    accounts = directory.select(C("username").alias("email")).distinct()
    listed = accounts.withColumn("_found", F.lit(True))
    return to_delete(run).join(listed, "email", "left").select(
        "user_id", "email", C("_found").isNotNull().alias("has_external_account")
    )


# Where a deleted user's rows live: by user, or through the user's customer.
_OWNED_BY_USER = {
    "users": "user_id",
    "stripe_customers": "user_id",
    "user_trials": "user_id",
    "user_profiles": "id",
    "linked_accounts": "user_id",
    "user_account_state": "user_id",
}
_OWNED_BY_CUSTOMER = ("stripe_subscriptions", "stripe_orders")


def purge_users(t: Tables, user_ids: DataFrame) -> Tables:
    """The tables without the given users; the deletion history stays."""
    gone = user_ids.select("user_id").distinct()
    gone_customers = t.stripe_customers.join(gone, "user_id", "left_semi").select("customer_id")
    kept = {
        name: getattr(t, name).join(
            gone.withColumnRenamed("user_id", key), key, "left_anti"
        )
        for name, key in _OWNED_BY_USER.items()
    }
    for name in _OWNED_BY_CUSTOMER:
        kept[name] = getattr(t, name).join(gone_customers, "customer_id", "left_anti")
    return t.replace(**kept)


_OWNER_COLUMN = {**_OWNED_BY_USER, **dict.fromkeys(_OWNED_BY_CUSTOMER, "customer_id")}
PURGED_TABLES = tuple(_OWNER_COLUMN)


def _owner(name: str) -> Column:
    """Who owns a row, user or customer, as one kind of key."""
    kind = "customer" if name in _OWNED_BY_CUSTOMER else "user"
    return F.concat(F.lit(f"{kind}:"), C(_OWNER_COLUMN[name]).cast("string"))


def owner_keys(t: Tables, user_ids: DataFrame) -> DataFrame:
    """``owner``: the given users and all their customers, also deleted ones."""
    gone = user_ids.select("user_id").distinct()
    customers = t.stripe_customers.select("user_id", "customer_id")
    both = gone.join(customers, "user_id", "left")
    owners = F.array(_owner("users"), _owner("stripe_orders"))
    return both.select(F.explode(owners).alias("owner")).filter("owner IS NOT NULL").distinct()


def without_owners(t: Tables, name: str, owners: DataFrame) -> DataFrame:
    """A table without the rows of the given ``owner_keys``; rows without an owner stay."""
    table = getattr(t, name).withColumn("owner", _owner(name))
    return table.join(owners, "owner", "left_anti").drop("owner")


def purge_counts(t: Tables, owners: DataFrame) -> DataFrame:
    """Rows removed from and remaining in each table, given the ``owner_keys`` that go.

    One pass: the rows of all tables are counted per owner before the shuffle, so an owner
    with very many rows weighs as much as any other, and meet the list once.
    """
    rows = reduce(
        DataFrame.unionByName,
        [
            getattr(t, name).select(_owner(name).alias("owner"), F.lit(i).alias("place"))
            for i, name in enumerate(PURGED_TABLES)
        ],
    )
    places = range(len(PURGED_TABLES))
    per_owner = rows.groupBy("owner").agg(
        *(F.count_if(C("place") == i).alias(f"n{i}") for i in places)
    )
    judged = per_owner.join(owners.withColumn("_gone", F.lit(True)), "owner", "left")
    none = F.lit(0).cast("long")
    sums = judged.agg(
        *(F.coalesce(F.sum(f"n{i}"), none).alias(f"n{i}") for i in places),
        *(F.coalesce(F.sum(F.when(C("_gone"), C(f"n{i}"))), none).alias(f"g{i}") for i in places),
    )
    told = F.array(
        *(
            F.struct(
                F.lit(name).alias("table_name"),
                C(f"g{i}").alias("removed"),
                (C(f"n{i}") - C(f"g{i}")).alias("remaining"),
            )
            for i, name in enumerate(PURGED_TABLES)
        )
    )
    return sums.select(F.inline(told))


def purge_report(t: Tables, user_ids: DataFrame) -> DataFrame:
    """Rows removed from and remaining in each table after a purge of the given users."""
    return purge_counts(t, owner_keys(t, user_ids))


def timed_steps(grace_days: int = GRACE_DAYS) -> Column:
    """A running trial's status changes to come, each with its time."""
    return F.array(
        F.struct(F.lit("expired").alias("trial_status"), C("trial_end_date").alias("due_at")),
        F.struct(
            F.lit("scheduled_for_deletion").alias("trial_status"),
            (C("trial_end_date") + clock.days(grace_days)).alias("due_at"),
        ),
    )


def timed_transitions(
    t: Tables, as_of: clock.Instant, protected: Protected, grace_days: int = GRACE_DAYS
) -> DataFrame:
    """Each expiry and scheduling that falls due by ``as_of``, at its own time.

    What a run at every instant would record for running trials of users
    neither paying nor protected: expiry at the trial's end and scheduling
    when the grace after it is over.
    """
    now = clock.instant(as_of)
    running = (
        flag_protected(t.user_trials, protected)
        .filter((C("trial_status") == "active") & ~C("_safe"))
        .select("user_id", "trial_end_date")
        .join(paying_users(t), "user_id", "left_anti")
    )
    steps = timed_steps(grace_days)
    return running.select("user_id", F.inline(steps)).filter(C("due_at") < now)
