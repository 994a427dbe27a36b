"""Every query by name, over the tables derived from a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions import clock
from tenure.functions.text import as_json_rows
from tenure.jobs.cleanup import CleanupJob
from tenure.model import Tables, struct
from tenure.operators import quality
from tenure.operators.entitlement import allowed_rows, entitled_rows, entitlement_grants
from tenure.operators.keyed import change_feed
from tenure.plans import access, accounts, billing, trials
from tenure.session import shared_dir
from tenure.sources.derived import AS_OF, PROTECTED_IDS, derived_stream, derived_tables
from tenure.sources.products import product_by_id
from tenure.sources.snapshots import BucketedSnapshot, StoredTables
from tenure.sources.tables import read_stream
from tenure.streaming.access import AccessFeed
from tenure.streaming.signups import SignupStream
from tenure.streaming.timers import run_trial_timers
from tenure.streaming.webhooks import WebhookStream

C = F.col

#: Buckets of the snapshots that queries write for themselves.
SNAPSHOT_BUCKETS = 16

_TRIAL_VIEW = ("user_id", "trial_status", "deletion_scheduled_at", "updated_at")
_STATE_VIEW = (
    "user_id",
    "account_status",
    "has_access",
    "access_level",
    "stripe_customer_id",
    "stripe_subscription_id",
    "subscription_status",
    "current_period_end",
    "external_user_id",
    "external_status",
    "trial_days_remaining",
    "updated_at",
    "last_activity_at",
)
_PROFILE_VIEW = ("id", "email", "full_name", "company", "is_active", "created_at", "updated_at")
_HISTORY_VIEW = (
    "id",
    "original_user_id",
    "email",
    "full_name",
    "trial_start_date",
    "trial_end_date",
    "trial_completed",
    "ever_subscribed",
    "last_subscription_status",
    "subscription_cancelled_date",
    "account_deleted_at",
    "deletion_reason",
    "can_get_new_trial",
)
SUBSCRIPTION_VIEW = (
    "customer_id",
    "subscription_id",
    "price_id",
    "current_period_start",
    "current_period_end",
    "cancel_at_period_end",
    "payment_method_brand",
    "payment_method_last4",
    "status",
    "created_at",
)
ORDER_VIEW = (
    "checkout_session_id",
    "payment_intent_id",
    "customer_id",
    "amount_subtotal",
    "amount_total",
    "currency",
    "payment_status",
    "status",
)
SIGNUP_VIEW = (
    "user_id",
    "email",
    "full_name",
    "account_status",
    "has_access",
    "access_level",
    "trial_days_remaining",
    "trial_start_date",
    "trial_end_date",
    "trial_status",
    "deletion_scheduled_at",
)


def _cleanup(t: Tables) -> CleanupJob:
    """A cleanup of its own; the second check comes after the billing events have come in."""
    after = billing.subscription_upsert(t, t.webhook_events, AS_OF)
    spark = t.users.sparkSession
    recheck = t.replace(stripe_subscriptions=after)
    return CleanupJob(spark, t, AS_OF, PROTECTED_IDS, shared_dir(spark, "cleanup"), recheck)


def _deletion_run(t: Tables) -> DataFrame:
    """The run without a job around it."""
    after = billing.subscription_upsert(t, t.webhook_events, AS_OF)
    recheck = t.replace(stripe_subscriptions=after)
    return trials.deletion_run(t, AS_OF, PROTECTED_IDS, recheck=recheck)


def _cleanup_outcomes(t: Tables) -> DataFrame:
    """The end state of a whole cleanup, per user of its list."""
    job = _cleanup(t)
    after = job.run()
    left = after.users.select("user_id", F.lit(True).alias("_left"))
    on_record = after.deleted_account_history.select("email", F.lit(True).alias("_recorded"))
    external = job.results().select("user_id", "has_external_account")
    return (
        job.listed()
        .join(external, "user_id", "left")
        .join(left, "user_id", "left")
        .join(on_record, "email", "left")
        .select(
            "user_id",
            "email",
            "decision",
            F.coalesce("has_external_account", F.lit(False)).alias("has_external_account"),
            C("_recorded").isNotNull().alias("recorded"),
            C("_left").isNotNull().alias("still_a_user"),
        )
    )


def _asked_rows(t: Tables) -> DataFrame:
    """Rows that users ask for: their own trial, the next user's, and the history."""

    def ask(table: str, row_key) -> DataFrame:
        return t.users.select(
            C("user_id").alias("viewer_id"),
            F.lit(table).alias("table_name"),
            row_key.cast("string").alias("row_key"),
        )

    history = t.deleted_account_history.select(
        (C("original_user_id") % 10).alias("viewer_id"),
        F.lit("deleted_account_history").alias("table_name"),
        C("email").alias("row_key"),
    )
    own = ask("user_trials", C("user_id"))
    return own.unionByName(ask("user_trials", C("user_id") + 1)).unionByName(history)


def _product_lookup(t: Tables) -> DataFrame:
    """What users find by product id; some ask for none, some for one that is not there."""
    ids = F.array(*(F.lit(x) for x in ("pro_product", "trial_product", "no_product", None)))
    asked = t.users.select("user_id", F.get(ids, (C("user_id") % 4).cast("int")).alias("asked"))
    found = asked.withColumn("found", product_by_id(C("asked")))
    return found.select(
        "user_id", "asked", "found.price_id", "found.product_name", "found.mode", "found.price"
    )


def _faulty(t: Tables) -> Tables:
    """The tables after some users were lost and some trials came twice, with an odd status."""
    twice = t.user_trials.filter("user_id % 11 = 0").withColumn("trial_status", F.lit("odd"))
    return t.replace(
        users=t.users.filter("user_id % 7 <> 0"), user_trials=t.user_trials.unionByName(twice)
    )


def _stored(t: Tables, name: str, key: str) -> BucketedSnapshot:
    """A table written anew as a bucketed snapshot."""
    table = getattr(t, name)
    spark = table.sparkSession
    snapshot = BucketedSnapshot(spark, shared_dir(spark, name), table.schema, key, SNAPSHOT_BUCKETS)
    snapshot.create(table)
    return snapshot


def _profile_snapshot(t: Tables) -> DataFrame:
    """``profile_upsert`` on stored buckets, of which only those of the batch are rewritten."""
    snapshot = _stored(t, "user_profiles", "id")
    snapshot.rewrite(
        t.profile_batch.select("user_id"),
        lambda old: accounts.profile_upsert(t.replace(user_profiles=old), t.profile_batch, AS_OF),
    )
    return snapshot.read()


def _snapshot_feed(t: Tables) -> DataFrame:
    """``change_feed`` between two states of the stored trials."""
    snapshot = _stored(t, "user_trials", "user_id")
    before = snapshot.state()
    snapshot.rewrite(
        t.user_trials.select("user_id"),
        lambda old: trials.sync_trials(t.replace(user_trials=old), AS_OF, PROTECTED_IDS),
    )
    return snapshot.changes(before)


def _trial_jobs() -> dict[str, Callable[[Tables], DataFrame]]:
    jobs = {
        "convert_paying_trials": lambda t: trials.convert_paying_trials(t, AS_OF),
        "expire_trials": lambda t: trials.expire_trials(t, AS_OF, PROTECTED_IDS),
        "schedule_deletions": lambda t: trials.schedule_deletions(t, AS_OF, PROTECTED_IDS),
        "protect_paying": lambda t: trials.protect_paying(t, AS_OF),
        "sync_trials": lambda t: trials.sync_trials(t, AS_OF, PROTECTED_IDS),
        "check_expired_trials": lambda t: trials.check_expired_trials(t, AS_OF, PROTECTED_IDS),
        "mark_converted": lambda t: trials.mark_converted(t, t.restore_batch, AS_OF),
        "subscription_change_effects": lambda t: billing.subscription_change_effects(
            t, billing.subscription_changes(t.webhook_events), AS_OF
        ),
    }
    return {name: (lambda t, job=job: job(t).select(*_TRIAL_VIEW)) for name, job in jobs.items()}


BATCH: dict[str, Callable[[Tables], DataFrame]] = {
    # access views
    "access_status": lambda t: access.access_status(t, AS_OF),
    "access_level": lambda t: access.access_level(t, AS_OF),
    "access_flags": lambda t: access.access_flags(t, AS_OF),
    "access_from_views": lambda t: access.access_from_views(t, AS_OF),
    "trial_info": lambda t: access.trial_info(t, AS_OF),
    "trial_info_client": lambda t: access.trial_info(t, AS_OF, days_mode="ceil"),
    "trial_countdown": lambda t: access.trial_countdown(t, AS_OF, PROTECTED_IDS),
    "user_subscriptions": access.user_subscriptions,
    "subscription_details": access.subscription_details,
    "user_orders": access.user_orders,
    "user_overview": access.user_overview,
    "overview_access": access.overview_access,
    "state_flags": access.state_flags,
    "admin_overview": access.admin_overview,
    "protection_status": access.protection_status,
    "current_plan": access.current_plan,
    "product_lookup": lambda t: _product_lookup(t),
    "subscription_label": access.subscription_label,
    "customer_nested": lambda t: access.customer_nested(t).select(
        "customer_id",
        F.to_json("subscriptions", {"ignoreNullFields": "false"}).alias("subscriptions"),
    ),
    "entitled_rows": lambda t: entitled_rows(
        t, t.users.select(C("user_id").alias("viewer_id")), PROTECTED_IDS
    ),
    "entitlement_grants": lambda t: entitlement_grants(
        t, t.users.select(C("user_id").alias("viewer_id")), PROTECTED_IDS
    ),
    "allowed_rows": lambda t: allowed_rows(t, _asked_rows(t), PROTECTED_IDS),
    # trial state machine
    "paying_users": access.paying_users,
    **_trial_jobs(),
    "timed_transitions": lambda t: trials.timed_transitions(t, AS_OF, PROTECTED_IDS),
    "change_feed": lambda t: change_feed(
        t.user_trials, trials.sync_trials(t, AS_OF, PROTECTED_IDS), "user_id"
    ),
    "snapshot_change_feed": lambda t: _snapshot_feed(t),
    # deletion
    "deletion_candidates": lambda t: trials.deletion_candidates(t, AS_OF, PROTECTED_IDS),
    "deletion_run": lambda t: _deletion_run(t),
    "deletion_run_report": lambda t: trials.deletion_run_report(_cleanup(t).listed()),
    "deletion_results": lambda t: trials.deletion_results(
        _cleanup(t).listed(), t.external_directory
    ),
    "purge_users": lambda t: trials.purge_report(t, _cleanup(t).doomed()),
    "deletion_history_record": lambda t: _cleanup(t).next_history().select(*_HISTORY_VIEW),
    "cleanup_outcomes": lambda t: _cleanup_outcomes(t),
    "deletion_history_listing": lambda t: accounts.deletion_history_listing(t).select(
        "original_user_id", "email", "account_deleted_at", "deletion_reason", "ever_subscribed"
    ),
    "safe_delete_outcomes": lambda t: accounts.safe_delete_outcomes(
        t, t.delete_requests, PROTECTED_IDS
    ),
    "safe_deletes": lambda t: accounts.safe_deletes(
        t, t.delete_requests, AS_OF, PROTECTED_IDS
    ).select(*_HISTORY_VIEW),
    # account state and provisioning
    "account_state_sync": lambda t: accounts.account_state_sync(t, AS_OF).select(*_STATE_VIEW),
    "state_sync_report": lambda t: accounts.state_sync_report(t, AS_OF),
    "state_sync_report_json": lambda t: as_json_rows(accounts.state_sync_report(t, AS_OF)),
    "system_metrics": lambda t: accounts.system_metrics(t, AS_OF),
    "system_metrics_json": lambda t: as_json_rows(
        accounts.system_metrics(t, AS_OF).drop("generated_at")
    ),
    "profile_upsert": lambda t: accounts.profile_upsert(t, t.profile_batch, AS_OF).select(
        *_PROFILE_VIEW
    ),
    "profile_snapshot_upsert": lambda t: _profile_snapshot(t).select(*_PROFILE_VIEW),
    "state_provisioning": lambda t: accounts.state_provisioning(
        t, t.profile_batch, AS_OF
    ).select(
        "user_id",
        "account_status",
        "has_access",
        "access_level",
        "trial_start_date",
        "trial_end_date",
        "trial_days_remaining",
    ),
    "profile_backfill": lambda t: accounts.profile_backfill(t, AS_OF).select(*_PROFILE_VIEW),
    "linked_account_upsert": lambda t: accounts.linked_account_upsert(
        t, t.link_batch, AS_OF
    ).select(
        "user_id",
        "external_user_id",
        "external_email",
        "account_status",
        "created_at",
        "updated_at",
        "last_sync_at",
    ),
    "linked_state_update": lambda t: accounts.linked_state_update(t, t.link_batch, AS_OF).select(
        "user_id", "external_user_id", "external_status", "updated_at"
    ),
    "customer_link_update": lambda t: accounts.customer_link_update(
        t, t.customer_link_batch, AS_OF
    ).select("user_id", "customer_id", "stripe_customer_email", "last_sync_at", "updated_at"),
    "customer_link_state": lambda t: accounts.customer_link_state(
        t, t.customer_link_batch, AS_OF
    ).select("user_id", "stripe_customer_id", "updated_at"),
    # returning users
    "email_trial_history": lambda t: accounts.email_trial_history(t, t.signups),
    "returning_users": lambda t: accounts.returning_users(t, t.signups),
    "resignup_decisions": lambda t: accounts.resignup_decisions(t, t.signups),
    "resignup_decisions_strict": lambda t: accounts.resignup_decisions(
        t, t.signups, strict_record=True
    ),
    "signup_provisioning": lambda t: accounts.signup_provisioning(t, t.signups).select(
        *SIGNUP_VIEW
    ),
    "restore_on_subscription": lambda t: accounts.restore_on_subscription(t, t.restore_batch),
    "restore_on_subscription_by_email": lambda t: accounts.restore_on_subscription(
        t, t.restore_batch, match_on="email"
    ),
    # billing events
    "webhook_routes": lambda t: billing.webhook_routes(t.webhook_events),
    "subscription_upsert": lambda t: billing.subscription_upsert(
        t, t.webhook_events, AS_OF
    ).select(*SUBSCRIPTION_VIEW),
    "order_inserts": lambda t: billing.order_inserts(t.webhook_events),
    "orders_after": lambda t: billing.orders_after(t, t.webhook_events).select(
        *ORDER_VIEW, "created_at"
    ),
    "checkout_validation": lambda t: billing.checkout_validation(t.checkout_requests),
    "checkout_body_validation": lambda t: billing.checkout_body_validation(t.checkout_bodies),
    "checkout_provisioning": lambda t: billing.checkout_provisioning(t, t.checkout_requests),
    "checkout_inserts": lambda t: billing.checkout_inserts(t, t.checkout_requests),
    "external_directory_match": lambda t: billing.external_directory_match(
        t, t.external_directory
    ),
    # integrity
    "constraint_violations": quality.constraint_violations,
    "offending_keys": lambda t: quality.offending_keys(_faulty(t)),
    "health_score": quality.health_score,
    "health_score_json": lambda t: as_json_rows(quality.health_score(t)),
}


def batch_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(job: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: job(derived_tables(spark, sf_dir))

    return {name: bind(job) for name, job in BATCH.items()}


# Streams --------------------------------------------------------------------
# Each replays its source file to the end and returns the state reached.


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_stream(spark, sf_dir, "webhook_events")


def _webhooks(spark: SparkSession, sf_dir: str) -> WebhookStream:
    t = derived_tables(spark, sf_dir)
    stream = WebhookStream(spark, t, AS_OF, shared_dir(spark, "webhooks"))
    return stream.run(_events(spark, sf_dir))


def stream_webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _webhooks(spark, sf_dir).subscriptions().select(*SUBSCRIPTION_VIEW)


def stream_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _webhooks(spark, sf_dir).new_orders().select(*ORDER_VIEW)


def stream_subscription_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _webhooks(spark, sf_dir).trials().select(*_TRIAL_VIEW)


def stream_synced_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _webhooks(spark, sf_dir).synced_trials(PROTECTED_IDS).select(*_TRIAL_VIEW)


def stream_access_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived_tables(spark, sf_dir)
    feed = AccessFeed(spark, t, AS_OF, shared_dir(spark, "access"))
    return feed.run(events=_events(spark, sf_dir)).latest()


def stream_trial_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived_tables(spark, sf_dir)
    feed = AccessFeed(spark, t, AS_OF, shared_dir(spark, "trial-access"))
    return feed.run(trials=derived_stream(spark, sf_dir, "user_trials")).latest()


def stream_access_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived_tables(spark, sf_dir)
    feed = AccessFeed(spark, t, AS_OF, shared_dir(spark, "access-feed"))
    trial_rows = derived_stream(spark, sf_dir, "user_trials")
    return feed.run(_events(spark, sf_dir), trial_rows).latest()


#: The live feed starts so long before the as-of time, to which a single tick moves it.
LIVE_FROM = "2024-01-26 00:00:00"


def stream_live_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who has access by the as-of time, of those whom an event or a trial's end has touched."""
    t = derived_tables(spark, sf_dir)
    root = shared_dir(spark, "live-access")
    spark.range(1).select(clock.instant(AS_OF).alias("at")).write.parquet(f"{root}/ticks")
    stored = StoredTables.store(t, f"{root}/base", SNAPSHOT_BUCKETS)
    feed = AccessFeed(spark, t, LIVE_FROM, f"{root}/feed", stored=stored)
    ticks = read_stream(spark, f"{root}/ticks", struct(at="ts"))
    query = feed.start(ticks, _events(spark, sf_dir), every="0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return feed.latest().select("user_id", "has_access", "access_type")


def stream_signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived_tables(spark, sf_dir)
    signups = derived_stream(spark, sf_dir, "signups")
    stream = SignupStream(spark, t, shared_dir(spark, "signups")).run(signups)
    return stream.provisioned().select(*SIGNUP_VIEW)


def stream_trial_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived_tables(spark, sf_dir)
    root = shared_dir(spark, "timers")
    tick = spark.range(1).select(clock.instant(AS_OF).alias("at"))
    tick.write.parquet(f"{root}/ticks")
    ticks = read_stream(spark, f"{root}/ticks", struct(at="ts"))
    due = run_trial_timers(
        spark,
        derived_stream(spark, sf_dir, "user_trials"),
        ticks,
        t,
        PROTECTED_IDS,
        root,
    )
    return due.filter(C("due_at") < clock.instant(AS_OF))


STREAMS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_webhooks": stream_webhooks,
    "stream_orders": stream_orders,
    "stream_subscription_effects": stream_subscription_effects,
    "stream_synced_trials": stream_synced_trials,
    "stream_access_updates": stream_access_updates,
    "stream_trial_access": stream_trial_access,
    "stream_access_feed": stream_access_feed,
    "stream_live_access": stream_live_access,
    "stream_signups": stream_signups,
    "stream_trial_timers": stream_trial_timers,
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**batch_queries(), **STREAMS}
