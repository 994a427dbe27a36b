"""Billing events as a stream: subscriptions, orders and trials.

Events may come repeated and in any order: the newest subscription per customer
and the first event per checkout session win, whatever batch brings them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.functions import clock
from tenure.model import Tables, struct
from tenure.plans import billing, trials
from tenure.plans.access import Protected
from tenure.sources.tables import MERGE_EVERY, ChangeLog
from tenure.streaming.run import drain, once_per_event

SUBSCRIPTION_LOG = struct(
    customer_id="string",
    status="string",
    subscription_id="string",
    price_id="string",
    current_period_start="long",
    current_period_end="long",
    cancel_at_period_end="boolean",
    payment_method_brand="string",
    payment_method_last4="string",
    method_given="boolean",
    subscription_created="ts",
    event_at="ts",
    event_id="string",
)
_ORDER_LOG = struct(
    checkout_session_id="string",
    payment_intent_id="string",
    customer_id="string",
    amount_subtotal="long",
    amount_total="long",
    currency="string",
    payment_status="string",
    status="string",
    created="ts",
    event_id="string",
)


class WebhookStream:
    """The state that a stream of billing events has reached."""

    def __init__(
        self,
        spark: SparkSession,
        t: Tables,
        as_of: clock.Instant,
        root: str,
        merge_every: int = MERGE_EVERY,
    ):
        self.t, self.as_of, self.root = t, as_of, root

        def log(name: str, schema: T.StructType, reduce) -> ChangeLog:
            return ChangeLog(
                spark, f"{root}/{name}", schema, lambda df: reduce(df.drop("batch_id")), merge_every
            )

        self._subscriptions = log("subscriptions", SUBSCRIPTION_LOG, billing.newest_candidates)
        self._payers = log("payers", struct(customer_id="string"), DataFrame.distinct)
        self._orders = log("orders", _ORDER_LOG, billing.first_orders)

    def _take(self, batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            newest = billing.newest_subscriptions(batch)
            self._subscriptions.write(newest, batch_id)
            changed = billing.subscription_changes(batch)
            self._payers.write(billing.paying_customers(changed), batch_id)
            self._orders.write(billing.first_orders(billing.paid_orders(batch)), batch_id)
        finally:
            batch.unpersist()

    def run(self, events: DataFrame, dedupe_within: str | None = None) -> "WebhookStream":
        events = once_per_event(events, "event_id", "created", dedupe_within)
        drain(events, self._take, f"{self.root}/checkpoint")
        return self

    def subscriptions(self) -> DataFrame:
        newest = billing.newest_candidates(self._subscriptions.read().drop("batch_id"))
        return billing.merge_subscriptions(self.t.stripe_subscriptions, newest, self.as_of)

    def new_orders(self) -> DataFrame:
        return billing.first_orders(self._orders.read().drop("batch_id"))

    def orders(self) -> DataFrame:
        return billing.insert_orders(self.t, self.new_orders())

    def trials(self) -> DataFrame:
        """Trials after every change to a paying status, also one that a later
        event has undone: conversion is for good."""
        payers = self._payers.read().withColumn("status", F.lit("active"))
        return billing.subscription_change_effects(self.t, payers, self.as_of)

    def synced_trials(self, protected: Protected) -> DataFrame:
        """Trials after the sync that follows the events."""
        now = self.t.replace(
            stripe_subscriptions=self.subscriptions(), user_trials=self.trials()
        )
        return trials.sync_trials(now, self.as_of, protected)
