from itertools import product

import pytest
from hand import AS_OF, DAY, by, customer, history, state, subscription, tables, trial, user
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tenure.model import PAYING_STATUSES, SUBSCRIPTION_STATUSES, TRIAL_STATUSES
from tenure.operators import quality
from tenure.operators.entitlement import (
    allowed_rows,
    entitled_rows,
    entitlement_grants,
    rows_of,
)
from tenure.plans import access
from tenure.sources.products import PRODUCTS, products


def test_trial_ending_exactly_now_gives_no_access(spark):
    t = tables(spark, user_trials=[trial(1, end=AS_OF), trial(2, end=AS_OF + DAY)])
    rows = by(access.access_status(t, AS_OF))
    assert (rows[1].has_access, rows[1].access_type) == (False, "no_access")
    assert (rows[1].seconds_remaining, rows[1].days_remaining) == (0, 0)
    assert (rows[2].has_access, rows[2].access_type) == (True, "free_trial")
    assert (rows[2].seconds_remaining, rows[2].days_remaining) == (86400, 1)


def test_deleted_rows_before_and_after_the_join(spark):
    t = tables(
        spark,
        user_trials=[trial(i) for i in (1, 2, 3)],
        stripe_customers=[customer(1), customer(2), customer(3, deleted=True)],
        stripe_subscriptions=[
            subscription(1),
            subscription(2, deleted=True),
            subscription(3),
        ],
    )
    rows = by(access.access_status(t, AS_OF))
    assert rows[1].subscription_status == "active"
    assert rows[2].subscription_status is None and rows[2].access_type == "free_trial"
    assert rows[3].subscription_status is None
    assert set(by(access.user_subscriptions(t), "customer_id")) == {"cus_1"}
    details = by(access.subscription_details(t), "customer_id")
    assert set(details) == {"cus_1", "cus_2"}
    assert details["cus_2"].subscription_status == "not_started"


def test_every_state_against_the_rule(spark):
    """All statuses, trial states, deletions and ends, against plain Python."""
    cases = list(
        product(
            (None, *SUBSCRIPTION_STATUSES),
            TRIAL_STATUSES,
            (False, True),
            (False, True),
            (-DAY, 0 * DAY, DAY),
        )
    )
    t = tables(
        spark,
        user_trials=[trial(i, c[1], end=AS_OF + c[4]) for i, c in enumerate(cases)],
        stripe_customers=[customer(i, deleted=c[2]) for i, c in enumerate(cases)],
        stripe_subscriptions=[
            subscription(i, c[0], deleted=c[3]) for i, c in enumerate(cases) if c[0]
        ],
    )
    rows = by(access.access_status(t, AS_OF))
    payers = {r.user_id for r in access.paying_users(t).collect()}
    assert len(rows) == len(cases)
    for i, (status, trial_status, c_gone, s_gone, left) in enumerate(cases):
        held = None if c_gone or s_gone else status
        if held == "active":
            expected = "paid_subscription"
        elif held == "trialing":
            expected = "stripe_trial"
        elif trial_status == "active" and left > 0 * DAY:
            expected = "free_trial"
        else:
            expected = "no_access"
        assert rows[i].access_type == expected, cases[i]
        assert rows[i].has_access == (expected != "no_access")
        assert (i in payers) == (held in PAYING_STATUSES)


@settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.tuples(
            st.sampled_from(TRIAL_STATUSES),
            st.timedeltas(min_value=-20 * DAY, max_value=20 * DAY),
        ),
        min_size=1,
        max_size=30,
    )
)
def test_time_left(spark, cases):
    t = tables(
        spark, user_trials=[trial(i, s, end=AS_OF + left) for i, (s, left) in enumerate(cases)]
    )
    floor, ceil = by(access.trial_info(t, AS_OF)), by(access.trial_info(t, AS_OF, "ceil"))
    micro = DAY / 86_400_000_000
    for i, (_, left) in enumerate(cases):
        us = max(left // micro, 0)
        assert floor[i].days_remaining == us // 86_400_000_000
        assert floor[i].seconds_remaining == (us + 500_000) // 1_000_000
        assert ceil[i].days_remaining == -(-us // 86_400_000_000)
        assert ceil[i].seconds_remaining == us // 1_000_000


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_results_do_not_depend_on_the_session_zone(spark, zone):
    from datetime import datetime

    start = datetime(2024, 3, 9, 12)  # a clock change lies within the trial
    t = tables(
        spark,
        user_trials=[trial(1, end=start + 2 * DAY)],
        stripe_customers=[customer(1)],
        stripe_subscriptions=[subscription(1)],
        users=[user(1)],
    )
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = access.trial_info(t, start).collect()[0]
        label = access.subscription_label(t).collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (row.days_remaining, row.seconds_remaining) == (2, 172800)
    assert label.renews_on == "2024-01-31"


def test_countdown_texts_and_banners(spark):
    minute = DAY / 1440
    t = tables(
        spark,
        users=[user(i, created_at=AS_OF - 6 * DAY - i * minute) for i in range(6)],
        user_trials=[
            trial(0, end=AS_OF + 2 * DAY + 61 * minute),
            trial(1, end=AS_OF + 61 * minute),
            trial(2, end=AS_OF + minute),
            trial(3, end=AS_OF),
            trial(4, "scheduled_for_deletion", end=AS_OF - DAY),
            trial(5, end=AS_OF + 3 * DAY),
        ],
        user_account_state=[state(0), state(1, account_status="trial_expired"), state(5)],
    )
    rows = by(access.trial_countdown(t, AS_OF, [5]))
    assert [rows[i].text for i in range(4)] == ["2d 1h 1m", "1h 1m", "1m", "Expired"]
    assert (rows[0].days, rows[0].hours, rows[0].minutes, rows[0].seconds) == (2, 1, 1, 0)
    assert [rows[i].banner for i in range(6)] == [
        "trial_active",
        "trial_expired",
        "trial_expired",
        "trial_expired",
        "deletion_scheduled",
        "trial_active",
    ]
    assert [rows[i].deletion_banner for i in (0, 1, 5)] == ["soon", "none", "exempt"]


def test_orders_of_a_hot_customer(spark):
    """One customer holds most orders; matches, gaps and deletions stay right."""
    orders = [
        {
            "id": i,
            "customer_id": "cus_1" if i % 3 else f"cus_{i % 7}",
            "status": "completed",
            "deleted_at": AS_OF if i % 5 == 0 else None,
        }
        for i in range(2000)
    ]
    orders.append({"id": 9000, "customer_id": "cus_8", "deleted_at": AS_OF})
    customers = [customer(i, deleted=i == 3) for i in range(10)]
    t = tables(spark, stripe_customers=customers, stripe_orders=orders)
    expected = set()
    for c in customers:
        if c["deleted_at"]:
            continue
        own = [o for o in orders if o["customer_id"] == c["customer_id"]]
        if not own:
            expected.add((c["customer_id"], None))
        expected |= {(c["customer_id"], o["id"]) for o in own if not o.get("deleted_at")}
    got = [(r.customer_id, r.order_id) for r in access.user_orders(t).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert ("cus_9", None) in expected and not any(c == "cus_8" for c, _ in expected)


def test_viewers_see_their_own_rows_only(spark):
    t = tables(
        spark,
        user_trials=[trial(1), trial(2)],
        stripe_customers=[customer(1), customer(2, deleted=True)],
        stripe_subscriptions=[subscription(1), subscription(2)],
    )
    viewers = t.user_trials.selectExpr("user_id as viewer_id")
    seen = {tuple(r) for r in entitled_rows(t, viewers, [2]).collect()}
    assert seen == {
        (1, "user_trials", "1"),
        (2, "user_trials", "2"),
        (1, "stripe_customers", "cus_1"),
        (1, "stripe_subscriptions", "cus_1"),
    }
    assert [r.user_id for r in rows_of(access.trial_info(t, AS_OF), 1).collect()] == [1]


def test_products(spark):
    rows = by(products(spark), "product_id")
    assert {p[0] for p in PRODUCTS} == set(rows)
    assert str(rows["pro_product"].price) == "45.00"


def test_an_admin_is_one_grant_however_long_the_history(spark):
    """Ten thousand admins, two of whom ask; the grants answer as the rows would."""
    history_rows = [history(f"gone{i}@example.com") for i in range(300)]
    t = tables(spark, user_trials=[trial(1), trial(2)], deleted_account_history=history_rows)
    admins = spark.range(1, 10_001).selectExpr("id as viewer_id")
    viewers = spark.range(10_500).selectExpr("id as viewer_id")
    grants = entitlement_grants(t, viewers, admins)
    assert grants.filter("scope = 'all'").count() == 10_000
    assert sorted(r.row_key for r in grants.filter("scope = 'row'").collect()) == ["1", "2"]
    emails = ["gone7@example.com", "gone8@example.com", "none@example.com"]
    asked = [(v, "deleted_account_history", e) for v in (3, 4, 10_400) for e in emails]
    asked += [(1, "user_trials", "1"), (1, "user_trials", "2"), (1, "user_trials", "1")]
    frame = spark.createDataFrame(asked, "viewer_id long, table_name string, row_key string")
    found = {tuple(r)[:3]: r.allowed for r in allowed_rows(t, frame, admins).collect()}
    whole = {tuple(r) for r in entitled_rows(t, viewers, [3, 4]).collect()}
    assert found == {key: key in whole for key in asked}
    assert found == {
        tuple(r)[:3]: r.allowed for r in allowed_rows(t, frame, list(range(1, 10_001))).collect()
    }


def test_offending_keys_add_up_to_the_violations(spark):
    t = tables(
        spark,
        users=[user(1), user(2), user(2)],
        user_trials=[trial(1), trial(1, "odd"), trial(9, id=None), trial(None, id=5)],
        stripe_customers=[customer(1), customer(3), customer(4, customer_id="cus_3")],
        stripe_subscriptions=[subscription(3), subscription(8)],
    )
    found = {tuple(r) for r in quality.offending_keys(t).collect()}
    assert {
        ("unique:user_id", "users", "2", 2),
        ("unique:user_id", "user_trials", "1", 2),
        ("unique:customer_id", "stripe_customers", "cus_3", 2),
        ("values:trial_status", "user_trials", "1", 1),
        ("not_null:id", "user_trials", None, 1),
        ("not_null:user_id", "user_trials", "5", 1),
        ("reference:user_id", "user_trials", "9", 1),
        ("reference:customer_id", "stripe_subscriptions", "cus_8", 1),
    } <= found
    told = {}
    for rule, table, _, rows in found:
        told[rule, table] = told.get((rule, table), 0) + (1 if rule.startswith("unique") else rows)
    counted = {(r.rule, r.table_name): r.violations for r in quality.constraint_violations(t).collect()}
    assert {k: v for k, v in counted.items() if v} == told
