import json
from collections import Counter
from datetime import datetime

from hand import AS_OF, DAY, by, customer, frame, subscription, tables, trial
from pyspark.sql import functions as F

from tenure.model import struct
from tenure.plans import billing
from tenure.session import shared_dir
from tenure.sources.webhooks import parse_events
from tenure.streaming.webhooks import WebhookStream


def event(event_id, kind="customer.subscription.updated", customer="cus_1", **more):
    row = {
        "event_id": f"evt_{event_id:03d}",
        "type": kind,
        "created": AS_OF - DAY + event_id * DAY / 86400,
        "customer": customer,
        **more,
    }
    if kind.startswith("customer.subscription") and "subscription_status" in more:
        row.setdefault("subscription_id", f"sub_{event_id}")
    return row


def events(spark, *rows):
    return frame(spark, "webhook_events", rows)


def checkout(event_id, session, **more):
    more = {"mode": "payment", "payment_status": "paid", **more}
    return event(event_id, "checkout.session.completed", checkout_session_id=session, **more)


def test_routes_take_the_first_rule(spark):
    rows = by(
        billing.webhook_routes(
            events(
                spark,
                event(1, customer=None),
                event(2, "payment_intent.succeeded"),
                event(3, "payment_intent.succeeded", invoice="in_1"),
                checkout(4, "cs_1"),
                checkout(5, "cs_2", payment_status="unpaid"),
                checkout(6, "cs_3", mode="subscription"),
                checkout(7, "cs_4", mode=None),
                event(8, "charge.refunded"),
            )
        ),
        "event_id",
    )
    assert {i: r.route for i, r in rows.items()} == {
        "evt_001": "skip_no_customer",
        "evt_002": "skip_one_time_intent",
        "evt_003": "subscription_sync",
        "evt_004": "order_insert",
        "evt_005": "ignored",
        "evt_006": "subscription_sync",
        "evt_007": "ignored",
        "evt_008": "subscription_sync",
    }


def test_newest_subscription_wins_and_method_is_kept(spark):
    t = tables(
        spark,
        stripe_subscriptions=[
            subscription(1, "active", payment_method_brand="visa", payment_method_last4="1111"),
            subscription(2, "active"),
            subscription(9, "paused"),
        ],
    )
    batch = events(
        spark,
        event(5, subscription_status="canceled"),
        event(3, subscription_status="active", payment_method_brand="amex"),
        event(4, "invoice.payment_failed"),
        event(6, "invoice.payment_failed", customer="cus_2"),
        event(7, customer="cus_3", subscription_status="trialing", payment_method_brand="amex"),
    )
    merged = billing.subscription_upsert(t, batch, AS_OF)
    rows = by(merged, "customer_id")
    assert (rows["cus_1"].status, rows["cus_1"].subscription_id) == ("canceled", "sub_5")
    assert (rows["cus_1"].payment_method_brand, rows["cus_1"].payment_method_last4) == (
        "visa",
        "1111",
    )
    assert (rows["cus_2"].status, rows["cus_2"].subscription_id) == ("active", "sub_2")
    assert (rows["cus_3"].status, rows["cus_3"].payment_method_brand) == ("trialing", "amex")
    assert rows["cus_9"].status == "paused"
    again = billing.subscription_upsert(t.replace(stripe_subscriptions=merged), batch, AS_OF)
    assert sorted(again.collect()) == sorted(merged.collect())


def test_an_old_subscriptions_late_event_does_not_win(spark):
    """Old and newer subscription take turns; the newer one's last event decides."""
    old, new = datetime(2024, 1, 1), datetime(2024, 1, 5)
    t = tables(spark, stripe_subscriptions=[subscription(1, "active")])
    batch = events(
        spark,
        event(1, subscription_status="active", subscription_id="A", subscription_created=old),
        event(2, subscription_status="active", subscription_id="B", subscription_created=new),
        event(3, subscription_status="canceled", subscription_id="A", subscription_created=old),
    )
    row = by(billing.subscription_upsert(t, batch, AS_OF), "customer_id")["cus_1"]
    assert (row.subscription_id, row.status) == ("B", "active")


def test_a_method_that_is_no_card_clears_the_old_one(spark):
    t = tables(
        spark,
        stripe_subscriptions=[
            subscription(1, "active", payment_method_brand="visa", payment_method_last4="1111")
        ],
    )
    batch = events(spark, event(1, subscription_status="active", payment_method_given=True))
    row = by(billing.subscription_upsert(t, batch, AS_OF), "customer_id")["cus_1"]
    assert (row.payment_method_brand, row.payment_method_last4) == (None, None)


def test_repeated_checkout_gives_one_order(spark):
    batch = events(spark, checkout(2, "cs_1", amount_total=7), checkout(1, "cs_1", amount_total=5))
    assert [r.amount_total for r in billing.order_inserts(batch).collect()] == [5]
    assert billing.paid_orders(batch).count() == 2  # without the reduction
    t = tables(spark, stripe_orders=[{"id": 1, "checkout_session_id": "cs_1"}])
    assert billing.orders_after(t, batch).count() == 1


def test_a_hot_customer_and_session(spark):
    """A third of all events belong to one customer and one session."""
    spread = F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 500)
    base = spark.range(30_000, numPartitions=6).withColumn("who", spread)
    batch = base.select(
        F.format_string("evt_%09d", "id").alias("event_id"),
        F.when(F.col("id") % 2 == 0, F.lit("customer.subscription.updated"))
        .otherwise(F.lit("checkout.session.completed"))
        .alias("type"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("created"),
        F.concat(F.lit("cus_"), "who").alias("customer"),
        F.lit("payment").alias("mode"),
        F.lit("paid").alias("payment_status"),
        F.concat(F.lit("cs_"), "who").alias("checkout_session_id"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("sub_"), "id")).alias("subscription_id"),
        F.lit("active").alias("subscription_status"),
    )
    from tenure.model import SCHEMAS
    from tenure.operators.keyed import conform

    batch = conform(batch, SCHEMAS["webhook_events"])
    newest, first = {}, {}
    for i in range(30_000):
        who = 1 if i % 3 == 0 else i % 500
        if i % 2 == 0:
            newest[f"cus_{who}"] = f"sub_{i}"
        else:
            first.setdefault(f"cs_{who}", f"cus_{who}")
    got = {r.customer_id: r.subscription_id for r in billing.newest_subscriptions(batch).collect()}
    assert got == newest
    orders = {r.checkout_session_id: r.customer_id for r in billing.order_inserts(batch).collect()}
    assert orders == first


def test_paying_change_converts(spark):
    t = tables(
        spark,
        user_trials=[trial(1), trial(2), trial(3)],
        stripe_customers=[customer(1), customer(2), customer(3, deleted=True)],
    )
    changed = frame(
        spark,
        None,
        [
            {"customer_id": "cus_1", "status": "trialing"},
            {"customer_id": "cus_1", "status": "canceled"},
            {"customer_id": "cus_2", "status": "past_due"},
            {"customer_id": "cus_3", "status": "active"},
        ],
        struct(customer_id="string", status="string"),
    )
    rows = by(billing.subscription_change_effects(t, changed, AS_OF))
    assert [rows[i].trial_status for i in (1, 2, 3)] == ["converted_to_paid", "active", "active"]


def test_checkout_actions(spark):
    schema = struct(
        event_id="long",
        user_id="long",
        price_id="string",
        success_url="string",
        cancel_url="string",
        mode="string",
    )

    def request(event_id, user_id, mode, **more):
        texts = {"price_id": "p", "success_url": "s", "cancel_url": "c"}
        return {"event_id": event_id, "user_id": user_id, "mode": mode, **texts, **more}

    t = tables(
        spark,
        stripe_customers=[customer(1), customer(2), customer(3, deleted=True)],
        stripe_subscriptions=[subscription(1, deleted=True)],
    )
    asked = frame(
        spark,
        None,
        [
            request(1, 1, "subscription"),
            request(2, 2, "subscription"),
            request(3, 2, "payment"),
            request(4, 3, "payment"),
            request(5, 4, "payment"),
            request(6, 4, "subscription"),
            request(7, 5, "payment"),
            request(8, 5, "gift"),
            request(9, 5, "gift", price_id=None),
        ],
        schema,
    )
    actions = by(billing.checkout_provisioning(t, asked), "event_id")
    assert {i: r.action for i, r in actions.items()} == {
        1: "ready",
        2: "create_subscription",
        3: "ready",
        4: "conflict_soft_deleted",
        5: "create_customer",
        6: "create_customer_and_subscription",
        7: "create_customer",
    }
    inserts = by(billing.checkout_inserts(t, asked))
    assert set(inserts) == {2, 4, 5}
    assert (inserts[2].customer_id, inserts[2].insert_customer) == ("cus_2", False)
    assert inserts[4].insert_customer and inserts[4].insert_subscription
    assert not inserts[5].insert_subscription
    reasons = by(billing.checkout_validation(asked), "event_id")
    assert reasons[1].reason is None
    assert reasons[8].reason == "Expected parameter mode to be one of payment, subscription"
    assert reasons[9].reason == "Missing required parameter price_id"


def test_directory_with_repeated_emails(spark):
    links = [{"user_id": i, "external_email": "same@example.com"} for i in range(50)]
    links.append({"user_id": 99, "external_email": "only@example.com"})
    directory = [{"username": e} for e in ["same@example.com"] * 50 + ["out@example.com"]]
    t = tables(spark, linked_accounts=links, external_directory=directory)
    rows = billing.external_directory_match(t, t.external_directory).collect()
    assert Counter(tuple(r) for r in rows) == Counter(
        [
            ("same@example.com", "matched"),
            ("only@example.com", "missing_outside"),
            ("out@example.com", "orphan_outside"),
        ]
    )


BAD_LINES = ["no json", "{\"type\": \"x\"}", "[1, 2]", "{\"id\": \"evt_9\""]


def raw_lines():
    method = {"card": {"brand": "visa", "last4": "4242"}}
    sub = {
        "id": "sub_1",
        "customer": "cus_1",
        "status": "active",
        "items": {"data": [{"price": {"id": "price_pro"}}]},
        "current_period_start": 1,
        "current_period_end": 2,
        "cancel_at_period_end": True,
    }

    def line(i, kind, obj):
        return json.dumps({"id": f"evt_{i}", "type": kind, "created": 86400 * i, "data": {"object": obj}})

    lines = [
        line(1, "customer.subscription.created", {**sub, "default_payment_method": method}),
        line(2, "customer.subscription.updated", {**sub, "default_payment_method": "pm_1"}),
        line(
            3,
            "checkout.session.completed",
            {"id": "cs_1", "customer": "cus_2", "mode": "payment", "payment_status": "paid"},
        ),
        line(4, "customer.subscription.created", {**sub, "customer": {"id": "cus_3"}}),
        line(5, "product.created", {"id": "prod_1"}),
        *BAD_LINES,
        "  ",
    ]
    return "\n".join(lines)


def test_raw_events(spark, tmp_path):
    path = tmp_path / "events.jsonl"
    path.write_text(raw_lines())
    parsed = parse_events(spark.read.text(str(path)))
    routes = billing.webhook_routes(parsed).collect()
    lost = {r.event_id: r.malformed for r in routes if r.route == "malformed"}
    assert sorted(lost.values()) == sorted(BAD_LINES) and len(routes) == 9
    assert {r.event_id for r in routes} - set(lost) == {f"evt_{i}" for i in range(1, 6)}
    rows = parsed.filter("malformed IS NULL").orderBy("created").collect()
    assert [r.customer for r in rows] == ["cus_1", "cus_1", "cus_2", None, None]
    assert (rows[0].payment_method_brand, rows[0].payment_method_last4) == ("visa", "4242")
    assert rows[1].payment_method_brand is None and rows[1].price_id == "price_pro"
    assert rows[2].checkout_session_id == "cs_1" and rows[2].subscription_id is None
    assert rows[0].created.day == 2
    newest = by(billing.newest_subscriptions(parsed), "customer_id")
    assert newest["cus_1"].status == "active"
    assert billing.order_inserts(parsed).count() == 1


def test_raw_events_as_a_stream(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(raw_lines())
    (tmp_path / "b.jsonl").write_text(raw_lines())
    t = tables(spark, user_trials=[trial(1)], stripe_customers=[customer(1)])
    events = parse_events(
        spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path))
    )
    run = WebhookStream(spark, t, AS_OF, shared_dir(spark, "test")).run(events)
    rows = by(run.subscriptions(), "customer_id")
    assert rows["cus_1"].status == "active" and rows["cus_1"].price_id == "price_pro"
    assert by(run.trials())[1].trial_status == "converted_to_paid"
    assert run.new_orders().count() == 1

def test_products_by_id_and_by_price(spark):
    from tenure.sources.products import product_by_id, product_name

    keys = spark.createDataFrame([("pro_product",), ("trial_price",), ("x",), (None,)], "k string")
    rows = keys.select(product_by_id(F.col("k")).alias("p"), product_name(F.col("k")).alias("n")).collect()
    assert (rows[0].p.price_id, rows[0].p.product_name, str(rows[0].p.price)) == ("price_pro", "Go Pro", "45.00")
    assert [r.p for r in rows[1:]] == [None] * 3
    assert [r.n for r in rows] == [None, "7-Day Free Trial", None, None]
