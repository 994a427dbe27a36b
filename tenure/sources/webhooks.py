"""Raw billing events, JSON lines as the payment provider sends them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions import clock
from tenure.model import SCHEMAS
from tenure.operators.keyed import conform

C = F.col

# The parts of an event that the jobs read.
PAYLOAD = """
    id string, type string, created bigint,
    data struct<object: struct<
        id: string, created: bigint, customer: string, invoice: string, mode: string,
        payment_status: string, payment_intent: string,
        amount_subtotal: bigint, amount_total: bigint, currency: string,
        status: string, current_period_start: bigint, current_period_end: bigint,
        cancel_at_period_end: boolean, default_payment_method: string,
        items: struct<data: array<struct<price: struct<id: string>>>>>>
"""
_CARD = "card struct<brand: string, last4: string>"


def _plain(text: Column) -> Column:
    """A text value; nested objects, read as their JSON text, count as absent."""
    return F.when(~text.startswith("{") & (text != ""), text)


def parse_events(lines: DataFrame) -> DataFrame:
    """``webhook_events`` rows from a text column ``value``, batch or stream.

    Only ``customer.subscription.*`` events carry a subscription. An expanded
    payment method brings brand and last digits, a bare reference to one does
    not. A line that is no event, without an id or a type, keeps its whole text in
    ``malformed``, and a hash of it as id; blank lines are no lines.
    """
    event = F.from_json("value", PAYLOAD)
    obj = C("event.data.object")
    is_subscription = C("event.type").startswith("customer.subscription.")
    is_checkout = C("event.type") == "checkout.session.completed"
    given = F.coalesce(obj["default_payment_method"].startswith("{"), F.lit(False))
    card = F.from_json(obj["default_payment_method"], _CARD)["card"]
    price = F.get(obj["items"]["data"], F.lit(0))["price"]["id"]
    carried = {
        "subscription_id": obj["id"],
        "subscription_status": obj["status"],
        "subscription_created": clock.from_epoch(obj["created"]),
        "price_id": price,
        "current_period_start": obj["current_period_start"],
        "current_period_end": obj["current_period_end"],
        "cancel_at_period_end": obj["cancel_at_period_end"],
        "payment_method_given": given,
        "payment_method_brand": card["brand"],
        "payment_method_last4": card["last4"],
    }
    unread = C("event.id").isNull() | C("event.type").isNull()
    filled = lines.filter(F.length(F.trim("value")) > 0)
    rows = filled.select(event.alias("event"), C("value").alias("line")).select(
        F.when(~unread, C("event.id"))
        .otherwise(F.concat(F.lit("malformed_"), F.sha2("line", 256)))
        .alias("event_id"),
        F.when(unread, C("line")).alias("malformed"),
        C("event.type").alias("type"),
        clock.from_epoch(C("event.created")).alias("created"),
        _plain(obj["customer"]).alias("customer"),
        obj["mode"].alias("mode"),
        obj["payment_status"].alias("payment_status"),
        obj["invoice"].alias("invoice"),
        F.when(is_checkout, obj["id"]).alias("checkout_session_id"),
        obj["payment_intent"].alias("payment_intent_id"),
        obj["amount_subtotal"].alias("amount_subtotal"),
        obj["amount_total"].alias("amount_total"),
        obj["currency"].alias("currency"),
        *[F.when(is_subscription, v).alias(n) for n, v in carried.items()],
    )
    return conform(rows, SCHEMAS["webhook_events"])
