from compare import spark_rows
from hand import (
    AS_OF,
    DAY,
    by,
    customer,
    frame,
    history,
    profile,
    state,
    subscription,
    tables,
    trial,
    user,
)

from tenure.model import struct
from tenure.plans import accounts

SIGNUP = struct(user_id="long", email="string", full_name="string", created_at="ts")


def signups(spark, *rows):
    return frame(spark, None, rows, SIGNUP)


def signup(user_id, email=None, **more):
    email = email or f"u{user_id}@example.com"
    return {"user_id": user_id, "email": email, "created_at": AS_OF, **more}


def test_state_follows_subscription_then_trial(spark):
    status = {2: "active", 3: "trialing", 4: "past_due", 5: "canceled", 6: "unpaid", 7: "paused"}
    ids = (*status, 8, 9)
    t = tables(
        spark,
        user_trials=[trial(i) for i in ids if i != 9],
        stripe_customers=[customer(i) for i in status],
        stripe_subscriptions=[subscription(i, s) for i, s in status.items()],
        user_account_state=[state(i) for i in ids],
    )
    rows = by(accounts.account_state_sync(t, AS_OF))
    found = {i: (r.account_status, r.has_access, r.access_level) for i, r in rows.items()}
    assert found == {
        2: ("subscription_active", True, "pro"),
        3: ("subscription_trialing", True, "pro"),
        4: ("subscription_past_due", False, "suspended"),
        5: ("subscription_canceled", False, "trial"),
        6: ("trial_active", True, "trial"),
        7: ("trial_active", True, "trial"),
        8: ("trial_active", True, "trial"),
        9: ("trial_expired", False, "suspended"),
    }
    assert rows[8].trial_days_remaining == 3 and rows[9].trial_days_remaining == 0


def test_sync_report_counts_profiles_without_state(spark):
    t = tables(
        spark,
        user_profiles=[profile(2), profile(3), profile(4, is_active=False)],
        user_account_state=[state(2), state(4)],
    )
    total = accounts.state_sync_report(t, AS_OF).filter("is_total").collect()
    assert [(r.profiles_considered, r.states_updated) for r in total] == [(2, 1)]


def test_known_email_under_both_rules(spark):
    complete = {
        "full_name": "A",
        "trial_start_date": AS_OF,
        "trial_end_date": AS_OF,
        "last_subscription_status": "canceled",
        "subscription_cancelled_date": AS_OF,
        "created_at": AS_OF,
        "updated_at": AS_OF,
    }
    t = tables(
        spark,
        deleted_account_history=[
            history("a@example.com"),
            history("b@example.com", 2, **complete),
        ],
    )
    batch = signups(
        spark, signup(10, "a@example.com"), signup(11, "b@example.com"), signup(12)
    )
    plain = by(accounts.resignup_decisions(t, batch))
    strict = by(accounts.resignup_decisions(t, batch, strict_record=True))
    assert [plain[i].is_returning_user for i in (10, 11, 12)] == [True, True, False]
    assert [strict[i].is_returning_user for i in (10, 11, 12)] == [False, True, False]
    assert plain[12].trial_allowed and not plain[10].trial_allowed


def test_emails_match_by_exact_case(spark):
    t = tables(spark, deleted_account_history=[history("a@example.com")])
    batch = signups(spark, signup(10, "A@example.com"))
    assert not by(accounts.resignup_decisions(t, batch))[10].is_returning_user
    assert accounts.email_trial_history(t, batch).count() == 0


def test_signup_journey(spark):
    """New user, returning user, and a replay that changes nothing."""
    t = tables(spark, deleted_account_history=[history("old@example.com")])
    batch = signups(
        spark, signup(10, full_name="Ten"), signup(11, "old@example.com")
    )
    shown = by(accounts.signup_provisioning(t, batch))
    after = accounts.apply_signups(t, batch)
    states, tried = by(after.user_account_state), by(after.user_trials)
    for i in (10, 11):
        assert shown[i].account_status == states[i].account_status
        assert shown[i].access_level == states[i].access_level
        assert shown[i].trial_status == tried[i].trial_status
        assert shown[i].trial_end_date == tried[i].trial_end_date
    assert (states[10].account_status, tried[10].trial_end_date) == (
        "trial_active",
        AS_OF + 7 * DAY,
    )
    assert (states[11].account_status, states[11].has_access) == ("trial_expired", False)
    assert (tried[11].trial_status, tried[11].trial_end_date) == ("expired", AS_OF)
    assert by(after.user_profiles, "id")[10].full_name == "Ten"
    again = accounts.apply_signups(after, batch)
    for name in ("user_profiles", "user_account_state", "user_trials"):
        assert sorted(getattr(again, name).collect()) == sorted(getattr(after, name).collect())


def test_upsert_keeps_a_known_name(spark):
    t = tables(spark, user_profiles=[profile(2), profile(3)])
    batch = signups(spark, signup(2, "new@example.com"), signup(4, full_name="Four"))
    rows = by(accounts.profile_upsert(t, batch, AS_OF), "id")
    assert (rows[2].email, rows[2].full_name) == ("new@example.com", "User 2")
    assert rows[3].updated_at is None
    assert (rows[4].full_name, rows[4].is_active) == ("Four", True)
    once = accounts.profile_upsert(t, batch, AS_OF)
    twice = accounts.profile_upsert(t.replace(user_profiles=once), batch, AS_OF)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_second_deletion_only_changes_date_and_reason(spark):
    requests = struct(user_id="long", email="string", reason="string")
    t = tables(
        spark,
        users=[user(2), user(3)],
        user_trials=[trial(2, "converted_to_paid"), trial(3)],
        stripe_customers=[customer(2), customer(3)],
        stripe_subscriptions=[subscription(2, "canceled")],
        deleted_account_history=[history("u3@example.com", 99)],
    )
    asked = [
        {"user_id": i, "email": f"u{i}@example.com", "reason": "user_request"} for i in (2, 3)
    ]
    rows = by(
        accounts.deletion_history_record(t, frame(spark, None, asked, requests), AS_OF), "email"
    )
    fresh, known = rows["u2@example.com"], rows["u3@example.com"]
    assert (fresh.trial_completed, fresh.ever_subscribed) == (True, True)
    assert fresh.subscription_cancelled_date == AS_OF
    assert (known.original_user_id, known.ever_subscribed) == (99, False)
    assert (known.account_deleted_at, known.deletion_reason) == (AS_OF, "user_request")


def test_protected_and_unknown_accounts_are_not_recorded(spark):
    t = tables(spark, users=[user(1), user(2)])
    asked = t.users.select("user_id").union(t.users.selectExpr("user_id + 100"))
    rows = by(accounts.safe_delete_outcomes(t, asked, [1]))
    assert {i: r.outcome for i, r in rows.items()} == {
        1: "protected",
        2: "recorded",
        101: "not_found",
        102: "not_found",
    }
    saved = accounts.safe_deletes(t, asked, AS_OF, [1]).collect()
    assert [r.original_user_id for r in saved] == [2]


def test_restore_by_old_id_or_email(spark):
    restores = struct(
        user_id="long", email="string", customer_id="string", subscription_id="string"
    )
    t = tables(
        spark,
        user_trials=[trial(7, "expired")],
        user_account_state=[state(7)],
        deleted_account_history=[history("back@example.com", 3)],
    )
    batch = frame(
        spark,
        None,
        [{"user_id": 7, "email": "back@example.com", "customer_id": "c", "subscription_id": "s"}],
        restores,
    )
    for match_on, hit in (("user_id", False), ("email", True)):
        row = accounts.restore_on_subscription(t, batch, match_on).collect()[0]
        assert row.history_updated is hit
        after = accounts.apply_restores(t, batch, AS_OF, match_on)
        assert after.deleted_account_history.collect()[0].ever_subscribed is hit
        held, tried = after.user_account_state.collect()[0], after.user_trials.collect()[0]
        assert (held.account_status, held.access_level) == (row.account_status, row.access_level)
        assert tried.trial_status == row.trial_status == "converted_to_paid"
        assert held.stripe_subscription_id == "s"


def test_links(spark):
    batch = struct(user_id="long", customer_id="string", email="string")
    t = tables(
        spark,
        stripe_customers=[customer(2), customer(3)],
        user_account_state=[state(2), state(3)],
    )
    asked = frame(
        spark,
        None,
        [
            {"user_id": 2, "customer_id": "cus_2", "email": "x"},
            {"user_id": 3, "customer_id": "cus_other", "email": "y"},
        ],
        batch,
    )
    rows = by(accounts.customer_link_update(t, asked, AS_OF))
    assert (rows[2].stripe_customer_email, rows[3].stripe_customer_email) == ("x", None)
    states = by(accounts.customer_link_state(t, asked, AS_OF))
    assert states[3].stripe_customer_id == "cus_other"


def test_a_doubled_batch_changes_nothing_more(spark, sf_dir):
    from tenure.sources.derived import derived_tables

    t = derived_tables(spark, sf_dir)
    twice = lambda df: df.union(df)
    restored = accounts.apply_restores(t, twice(t.restore_batch), AS_OF)
    once = accounts.apply_restores(t, t.restore_batch, AS_OF)
    for name in ("user_trials", "user_account_state", "deleted_account_history"):
        assert spark_rows(getattr(restored, name)) == spark_rows(getattr(once, name))
    for job in (accounts.profile_upsert, accounts.state_provisioning):
        doubled = job(t, twice(t.profile_batch), AS_OF)
        assert spark_rows(doubled) == spark_rows(job(t, t.profile_batch, AS_OF))
