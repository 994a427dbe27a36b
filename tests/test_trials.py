from itertools import product

import pytest
from compare import spark_rows

from tenure.sources.derived import derived_tables
from hand import AS_OF, DAY, by, customer, subscription, tables, trial, user

from tenure.model import TRIAL_STATUSES
from tenure.plans import trials

SAFE = (1, 5, 11)


@pytest.fixture(scope="module")
def mixed(spark):
    """Every trial state, end and schedule, with and without a payer."""
    cases = list(
        product(
            TRIAL_STATUSES,
            (-3 * DAY, -DAY, -DAY / 2, 0 * DAY, 3 * DAY),
            (None, -DAY, 0 * DAY, DAY),
            (None, "active", "trialing", "canceled", "past_due"),
        )
    )
    ids = range(len(cases))
    return tables(
        spark,
        users=[user(i) for i in ids],
        user_trials=[
            trial(i, c[0], AS_OF + c[1], None if c[2] is None else AS_OF + c[2])
            for i, c in enumerate(cases)
        ],
        stripe_customers=[customer(i) for i in ids],
        stripe_subscriptions=[subscription(i, c[3]) for i, c in enumerate(cases) if c[3]],
    )


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_sync_is_its_three_steps(mixed):
    one = trials.convert_paying_trials(mixed, AS_OF)
    two = trials.expire_trials(mixed.replace(user_trials=one), AS_OF, SAFE)
    three = trials.schedule_deletions(mixed.replace(user_trials=two), AS_OF, SAFE)
    assert rows(trials.sync_trials(mixed, AS_OF, SAFE)) == rows(three)


def test_check_is_protect_then_sync_in_either_order(mixed):
    protect = mixed.replace(user_trials=trials.protect_paying(mixed, AS_OF))
    sync = mixed.replace(user_trials=trials.sync_trials(mixed, AS_OF, SAFE))
    expected = rows(trials.check_expired_trials(mixed, AS_OF, SAFE))
    assert rows(trials.sync_trials(protect, AS_OF, SAFE)) == expected
    assert rows(trials.protect_paying(sync, AS_OF)) == expected


def test_sync_twice_is_sync_once(mixed):
    once = trials.sync_trials(mixed, AS_OF, SAFE)
    again = trials.sync_trials(mixed.replace(user_trials=once), AS_OF, SAFE)
    assert rows(once) == rows(again)


def test_nobody_paying_or_protected_is_deleted(mixed):
    run = trials.deletion_run(mixed, AS_OF, SAFE)
    listed = {r.user_id for r in run.collect()}
    payers = {r.user_id for r in trials.paying_users(mixed).collect()}
    assert listed and not listed & payers and not listed & set(SAFE)
    synced = mixed.replace(user_trials=trials.check_expired_trials(mixed, AS_OF, SAFE))
    assert listed == set(by(trials.deletion_candidates(synced, AS_OF, SAFE)))
    report = trials.deletion_run_report(run).collect()[0]
    assert tuple(report) == (len(listed), 0, len(listed))


def test_who_pays_before_the_deletion_starts_is_spared(spark, mixed):
    listed = sorted(r.user_id for r in trials.deletion_run(mixed, AS_OF, SAFE).collect())
    paid = listed[:3]
    newer = tables(
        spark,
        stripe_customers=[customer(i) for i in paid],
        stripe_subscriptions=[subscription(i) for i in paid],
    )
    run = trials.deletion_run(mixed, AS_OF, SAFE, recheck=newer)
    spared = {r.user_id for r in run.filter("decision = 'protected'").collect()}
    assert spared == set(paid)
    report = trials.deletion_run_report(run).collect()[0]
    assert tuple(report) == (len(listed), 3, len(listed) - 3)


def test_boundaries(spark):
    t = tables(
        spark,
        users=[user(i) for i in range(8)],
        user_trials=[
            trial(0, end=AS_OF),
            trial(2, end=AS_OF - DAY / 86400),
            trial(3, "scheduled_for_deletion", end=AS_OF - DAY),
            trial(4, "scheduled_for_deletion", end=AS_OF - DAY - DAY / 86400),
            trial(5, "expired", end=AS_OF - 3 * DAY, scheduled=AS_OF - DAY),
            trial(6, "expired", end=AS_OF - 3 * DAY),
            trial(7, "expired", end=AS_OF - 3 * DAY, scheduled=AS_OF - DAY),
        ],
    )
    after = by(trials.sync_trials(t, AS_OF, SAFE))
    assert after[0].trial_status == "active"
    assert after[2].trial_status == "expired"
    assert after[2].deletion_scheduled_at == AS_OF + DAY
    assert after[5].trial_status == "expired"  # protected
    assert after[6].trial_status == "expired"  # never scheduled without a date
    assert after[7].trial_status == "scheduled_for_deletion"
    assert after[7].deletion_scheduled_at == AS_OF - DAY
    assert set(by(trials.deletion_candidates(t, AS_OF, SAFE))) == {4}


def test_conversion_is_for_good(spark):
    t = tables(
        spark,
        users=[user(2)],
        user_trials=[trial(2, "converted_to_paid", end=AS_OF - 9 * DAY)],
        stripe_customers=[customer(2)],
        stripe_subscriptions=[subscription(2, "canceled")],
    )
    from tenure.plans.access import access_status, protection_status

    assert not by(access_status(t, AS_OF))[2].has_access
    shown = by(protection_status(t))[2]
    assert (shown.is_protected, shown.protection_reason) == (True, "Previously converted to paid")
    assert by(trials.sync_trials(t, AS_OF, SAFE))[2].trial_status == "converted_to_paid"


def test_purge_removes_dependants_and_reports_them(spark):
    ids = (2, 3)
    orders = [
        {"id": i, "customer_id": f"cus_{2 if i % 3 else i % 2 + 3}"} for i in range(90)
    ]
    t = tables(
        spark,
        users=[user(i) for i in ids],
        user_trials=[trial(i) for i in ids],
        stripe_customers=[customer(i) for i in ids],
        stripe_subscriptions=[subscription(i) for i in ids],
        stripe_orders=orders,
    )
    gone = t.users.filter("user_id = 2")
    left = trials.purge_users(t, gone)
    report = by(trials.purge_report(t, gone), "table_name")
    for name in report:
        frame = getattr(left, name)
        assert report[name].remaining == frame.count()
        assert report[name].removed == getattr(t, name).count() - report[name].remaining
    assert (report["stripe_orders"].removed, report["stripe_orders"].remaining) == (60, 30)


def test_protected_accounts_may_be_a_table_of_any_size(spark, sf_dir):
    t = derived_tables(spark, sf_dir)
    whole = trials.sync_trials(t, AS_OF, spark.range(0, 1_000_000))
    joined = trials.sync_trials(t, AS_OF, range(1_000_000, 1_001_000))
    none = trials.sync_trials(t, AS_OF, ())
    converted = trials.convert_paying_trials(t, AS_OF)
    view = ("user_id", "trial_status", "deletion_scheduled_at")
    assert spark_rows(whole.select(*view)) == spark_rows(converted.select(*view))
    assert spark_rows(joined.select(*view)) == spark_rows(none.select(*view))


def test_no_protected_payer_is_purged_or_recorded(spark, sf_dir):
    t = derived_tables(spark, sf_dir)
    from tenure.catalog import _deletion_run

    run = _deletion_run(t)
    gone = trials.to_delete(run)
    saved = run.filter("decision = 'protected'").select("user_id")
    assert gone.join(saved, "user_id", "left_semi").isEmpty()
    assert gone.count() + saved.count() == run.count()
