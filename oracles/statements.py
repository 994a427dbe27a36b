"""One DuckDB statement per query, over the derived tables."""

from __future__ import annotations

from oracles.fixtures import with_fixtures
from tenure.sources.derived import AS_OF, PROTECTED_IDS

NOW = f"TIMESTAMP '{AS_OF}'"
SAFE = "(" + ", ".join(map(str, PROTECTED_IDS)) + ")"
PAYS = "('active', 'trialing')"

# Named queries that several statements build on.
SHARED = {
    "live_customers": "SELECT * FROM stripe_customers WHERE deleted_at IS NULL",
    "live_subscriptions": "SELECT * FROM stripe_subscriptions WHERE deleted_at IS NULL",
    "payers": "SELECT user_id FROM live_customers WHERE customer_id IN"
    f" (SELECT customer_id FROM live_subscriptions WHERE status IN {PAYS})",
    # A deleted subscription leaves its customer with empty columns ...
    "kept_bills": "SELECT c.user_id, s.customer_id IS NOT NULL AS subscribed, c.customer_id,"
    " s.* EXCLUDE (id, customer_id, created_at, updated_at, deleted_at)"
    " FROM live_customers c LEFT JOIN live_subscriptions s ON s.customer_id = c.customer_id",
    # ... or takes its customer along.
    "strict_bills": "SELECT * FROM kept_bills WHERE customer_id NOT IN"
    " (SELECT customer_id FROM stripe_subscriptions WHERE deleted_at IS NOT NULL)",
    "clocked": "SELECT user_id, trial_start_date, trial_end_date, trial_status,"
    " deletion_scheduled_at,"
    f" greatest(epoch_us(trial_end_date) - epoch_us({NOW}), 0) AS micros FROM user_trials",
    "access": "SELECT k.*, b.status AS subscription_status, b.subscription_id, b.price_id,"
    " b.current_period_end, cast(round(micros / 1000000.0) AS BIGINT) AS seconds_remaining,"
    " cast(micros // 86400000000 AS INTEGER) AS days_remaining,"
    f" coalesce(b.status IN {PAYS}, false) AS pays,"
    " k.trial_status = 'active' AND k.micros > 0 AS trying"
    " FROM clocked k LEFT JOIN kept_bills b ON b.user_id = k.user_id",
    "typed_access": "SELECT *, pays OR trying AS has_access, CASE WHEN subscription_status"
    " = 'active' THEN 'paid_subscription' WHEN pays THEN 'stripe_trial' WHEN trying THEN"
    " 'free_trial' ELSE 'no_access' END AS access_type FROM access",
    "flagged": "SELECT t.*, t.user_id IN (SELECT user_id FROM payers) AS pays,"
    f" t.user_id IN {SAFE} AS safe FROM user_trials t",
    # The sync in three successive steps.
    "step_convert": "SELECT * REPLACE ("
    "CASE WHEN pays THEN 'converted_to_paid' ELSE trial_status END AS trial_status,"
    " CASE WHEN pays AND trial_status <> 'converted_to_paid' THEN NULL"
    " ELSE deletion_scheduled_at END AS deletion_scheduled_at,"
    f" CASE WHEN pays AND trial_status <> 'converted_to_paid' THEN {NOW}"
    " ELSE updated_at END AS updated_at) FROM flagged",
    "due_expire": "SELECT user_id FROM step_convert WHERE trial_status = 'active'"
    f" AND trial_end_date < {NOW} AND NOT safe AND NOT pays",
    "step_expire": "SELECT s.* REPLACE ("
    "CASE WHEN d.user_id IS NULL THEN s.trial_status ELSE 'expired' END AS trial_status,"
    " CASE WHEN d.user_id IS NULL THEN s.deletion_scheduled_at"
    f" ELSE {NOW} + INTERVAL '1' DAY END AS deletion_scheduled_at,"
    f" CASE WHEN d.user_id IS NULL THEN s.updated_at ELSE {NOW} END AS updated_at)"
    " FROM step_convert s LEFT JOIN due_expire d ON d.user_id = s.user_id",
    "due_schedule": "SELECT user_id FROM step_expire WHERE trial_status = 'expired'"
    f" AND deletion_scheduled_at < {NOW} AND NOT safe AND NOT pays",
    "step_schedule": "SELECT s.* REPLACE ("
    "CASE WHEN d.user_id IS NULL THEN s.trial_status ELSE 'scheduled_for_deletion' END"
    " AS trial_status,"
    f" CASE WHEN d.user_id IS NULL THEN s.updated_at ELSE {NOW} END AS updated_at)"
    " FROM step_expire s LEFT JOIN due_schedule d ON d.user_id = s.user_id",
    "run": "SELECT s.user_id, u.email, s.trial_end_date FROM step_schedule s"
    " JOIN users u ON u.user_id = s.user_id"
    " WHERE s.trial_status = 'scheduled_for_deletion' AND NOT s.safe AND NOT s.pays"
    f" AND s.trial_end_date < {NOW} - INTERVAL '1' DAY",
    "states": "SELECT s.user_id, b.status, b.customer_id, b.subscription_id,"
    " make_timestamp(b.current_period_end * 1000000) AS period_end, l.external_user_id,"
    " l.account_status AS link_status, coalesce(cast(k.micros // 86400000000 AS INTEGER), 0)"
    " AS days_left, coalesce(k.trial_status = 'active' AND k.micros > 0, false) AS trying"
    " FROM user_account_state s LEFT JOIN clocked k ON k.user_id = s.user_id"
    " LEFT JOIN strict_bills b ON b.user_id = s.user_id"
    " LEFT JOIN linked_accounts l ON l.user_id = s.user_id",
    "synced": "SELECT user_id, CASE WHEN status = 'active' THEN 'subscription_active'"
    " WHEN status IN ('trialing', 'past_due', 'canceled') THEN 'subscription_' || status"
    " WHEN trying THEN 'trial_active' ELSE 'trial_expired' END AS account_status,"
    f" coalesce(status IN {PAYS}, false) OR (trying AND coalesce(status NOT IN"
    " ('past_due', 'canceled'), true)) AS has_access,"
    f" CASE WHEN status IN {PAYS} THEN 'pro' WHEN status = 'past_due' THEN 'suspended'"
    " WHEN status = 'canceled' OR trying THEN 'trial' ELSE 'suspended' END AS access_level,"
    " customer_id AS stripe_customer_id, subscription_id AS stripe_subscription_id,"
    " status AS subscription_status, period_end AS current_period_end, external_user_id,"
    f" link_status AS external_status, days_left AS trial_days_remaining, {NOW} AS updated_at,"
    f" {NOW} AS last_activity_at FROM states",
    "overview": "SELECT p.id AS user_id, p.email, p.full_name, p.company,"
    " p.created_at AS user_created_at, p.last_login_at, a.account_status, a.has_access,"
    " a.access_level, a.trial_days_remaining, a.last_activity_at, t.trial_start_date,"
    " t.trial_end_date, t.trial_status, b.customer_id AS stripe_customer_id,"
    " b.subscription_id AS stripe_subscription_id, b.status AS stripe_status,"
    " b.current_period_end, b.price_id, l.external_user_id, l.external_email,"
    " l.account_status AS external_status, l.last_sync_at AS external_last_sync"
    " FROM user_profiles p LEFT JOIN user_account_state a ON a.user_id = p.id"
    " LEFT JOIN user_trials t ON t.user_id = p.id LEFT JOIN kept_bills b ON b.user_id = p.id"
    " LEFT JOIN linked_accounts l ON l.user_id = p.id",
    "routed": "SELECT *, CASE WHEN malformed IS NOT NULL THEN 'malformed'"
    " WHEN customer IS NULL THEN 'skip_no_customer'"
    " WHEN type = 'payment_intent.succeeded' AND invoice IS NULL THEN 'skip_one_time_intent'"
    " WHEN type <> 'checkout.session.completed' OR mode = 'subscription'"
    " THEN 'subscription_sync' WHEN mode = 'payment' AND payment_status = 'paid'"
    " THEN 'order_insert' ELSE 'ignored' END AS route FROM webhook_events",
    "newest": "SELECT c.customer AS customer_id, e.* FROM"
    " (SELECT DISTINCT customer FROM routed WHERE route = 'subscription_sync') c LEFT JOIN"
    " (SELECT * FROM routed WHERE route = 'subscription_sync' AND subscription_id IS NOT NULL"
    " QUALIFY row_number() OVER (PARTITION BY customer ORDER BY subscription_created DESC,"
    " created DESC, event_id DESC) = 1) e ON e.customer = c.customer",
    "merged": "SELECT coalesce(o.customer_id, n.customer_id) AS customer_id,"
    " coalesce(n.subscription_id, o.subscription_id) AS subscription_id,"
    " coalesce(n.price_id, o.price_id) AS price_id,"
    " coalesce(n.current_period_start, o.current_period_start) AS current_period_start,"
    " coalesce(n.current_period_end, o.current_period_end) AS current_period_end,"
    " coalesce(n.cancel_at_period_end, o.cancel_at_period_end, false) AS cancel_at_period_end,"
    " CASE WHEN n.payment_method_given THEN n.payment_method_brand"
    " ELSE o.payment_method_brand END AS payment_method_brand,"
    " CASE WHEN n.payment_method_given THEN n.payment_method_last4"
    " ELSE o.payment_method_last4 END AS payment_method_last4,"
    # Only a customer who has no subscription row yet gets the default.
    " CASE WHEN o.customer_id IS NULL THEN coalesce(n.subscription_status, 'not_started')"
    " WHEN n.subscription_id IS NULL THEN o.status ELSE n.subscription_status END AS status,"
    f" coalesce(o.created_at, {NOW}) AS created_at, o.deleted_at"
    " FROM stripe_subscriptions o FULL JOIN newest n ON n.customer_id = o.customer_id",
    # Trials after the events: converted for good, then expired and scheduled.
    "event_payers": "SELECT DISTINCT c.user_id FROM live_customers c"
    " JOIN routed e ON e.customer = c.customer_id WHERE e.route = 'subscription_sync'"
    f" AND e.subscription_status IN {PAYS}",
    "payers_after": "SELECT user_id FROM live_customers WHERE customer_id IN"
    f" (SELECT customer_id FROM merged WHERE deleted_at IS NULL AND status IN {PAYS})",
    # Who pays when the deletion starts is not deleted.
    "doomed": "SELECT user_id, email FROM run"
    " WHERE user_id NOT IN (SELECT user_id FROM payers_after)",
    "judged_after": "SELECT *, converts OR (pays_after AND trial_status <>"
    " 'converted_to_paid') AS paid, NOT converts AND NOT pays_after AND NOT safe AS open"
    " FROM (SELECT f.*, user_id IN (SELECT user_id FROM event_payers) AS converts,"
    " user_id IN (SELECT user_id FROM payers_after) AS pays_after FROM flagged f)",
    "first_orders": "SELECT * FROM routed WHERE route = 'order_insert' QUALIFY row_number()"
    " OVER (PARTITION BY checkout_session_id ORDER BY created, event_id) = 1",
    "known": "SELECT * FROM deleted_account_history",
    "complete_known": "SELECT * FROM deleted_account_history"
    " WHERE full_name IS NOT NULL AND last_subscription_status IS NOT NULL"
    " AND subscription_cancelled_date IS NOT NULL AND trial_start_date IS NOT NULL"
    " AND trial_end_date IS NOT NULL AND account_deleted_at IS NOT NULL",
    "reasons": "SELECT *, CASE WHEN price_id IS NULL THEN 'Missing required parameter price_id'"
    " WHEN success_url IS NULL THEN 'Missing required parameter success_url'"
    " WHEN cancel_url IS NULL THEN 'Missing required parameter cancel_url'"
    " WHEN mode IN ('payment', 'subscription') THEN NULL"
    " ELSE 'Expected parameter mode to be one of payment, subscription' END AS reason"
    " FROM checkout_requests",
    "judged": "SELECT r.event_id, r.user_id, c.customer_id, CASE WHEN c.user_id IS NULL THEN"
    " CASE r.mode WHEN 'payment' THEN 'create_customer'"
    " ELSE 'create_customer_and_subscription' END"
    " WHEN c.deleted_at IS NOT NULL THEN 'conflict_soft_deleted'"
    " WHEN r.mode = 'payment' OR c.customer_id IN (SELECT customer_id FROM"
    " stripe_subscriptions) THEN 'ready' ELSE 'create_subscription' END AS action"
    " FROM reasons r LEFT JOIN stripe_customers c ON c.user_id = r.user_id"
    " WHERE r.reason IS NULL",
    "outcomes": "SELECT r.user_id, u.email, CASE"
    f" WHEN r.user_id IN {SAFE} THEN 'protected' WHEN u.user_id IS NULL THEN 'not_found'"
    " ELSE 'recorded' END AS outcome FROM (SELECT DISTINCT user_id FROM delete_requests) r"
    " LEFT JOIN users u ON u.user_id = r.user_id",
}


def _history_after(requests: str) -> str:
    """The deletion history after recording the users of ``requests``."""
    return (
        "SELECT coalesce(h.id, sha256(concat(r.user_id, '|', r.email))) AS id,"
        " coalesce(h.original_user_id, r.user_id) AS original_user_id,"
        " coalesce(h.email, r.email) AS email, h.full_name,"
        " coalesce(h.trial_start_date, t.trial_start_date) AS trial_start_date,"
        " coalesce(h.trial_end_date, t.trial_end_date) AS trial_end_date,"
        " coalesce(h.trial_completed, t.trial_status = 'converted_to_paid', false)"
        " AS trial_completed,"
        " coalesce(h.ever_subscribed, b.status IS NOT NULL) AS ever_subscribed,"
        " CASE WHEN h.id IS NULL THEN b.status ELSE h.last_subscription_status END"
        " AS last_subscription_status,"
        " CASE WHEN h.id IS NOT NULL THEN h.subscription_cancelled_date"
        f" WHEN b.status = 'canceled' THEN {NOW} END AS subscription_cancelled_date,"
        f" CASE WHEN r.user_id IS NULL THEN h.account_deleted_at ELSE {NOW} END"
        " AS account_deleted_at, 'trial_expired' AS deletion_reason,"
        " coalesce(h.can_get_new_trial, false) AS can_get_new_trial"
        f" FROM deleted_account_history h FULL JOIN ({requests}) r ON r.email = h.email"
        " LEFT JOIN user_trials t ON t.user_id = r.user_id"
        " LEFT JOIN strict_bills b ON b.user_id = r.user_id"
    )


# The tables' declarations, written out apart from the library.
_FILLED = """
    stripe_customers.id stripe_customers.user_id stripe_customers.customer_id
    stripe_subscriptions.id stripe_subscriptions.customer_id stripe_subscriptions.status
    stripe_orders.id stripe_orders.checkout_session_id stripe_orders.payment_intent_id
    stripe_orders.customer_id stripe_orders.amount_subtotal stripe_orders.amount_total
    stripe_orders.currency stripe_orders.payment_status stripe_orders.status
    user_trials.id user_trials.user_id user_trials.trial_start_date user_trials.trial_end_date
    user_trials.trial_status user_trials.created_at user_trials.updated_at
    user_profiles.id user_profiles.email
    linked_accounts.id linked_accounts.user_id linked_accounts.external_user_id
    linked_accounts.external_email
    user_account_state.user_id user_account_state.account_status
    deleted_account_history.id deleted_account_history.original_user_id
    deleted_account_history.email
""".split()
_LISTED = {
    "stripe_subscriptions.status": "'not_started', 'incomplete', 'incomplete_expired',"
    " 'trialing', 'active', 'past_due', 'canceled', 'unpaid', 'paused'",
    "stripe_orders.status": "'pending', 'completed', 'canceled'",
    "user_trials.trial_status": "'active', 'expired', 'converted_to_paid',"
    " 'scheduled_for_deletion'",
    "user_account_state.account_status": "'trial_active', 'trial_expired',"
    " 'subscription_active', 'subscription_trialing', 'subscription_past_due',"
    " 'subscription_canceled', 'account_suspended', 'account_deleted'",
    "user_account_state.access_level": "'trial', 'pro', 'enterprise', 'suspended'",
    "linked_accounts.account_status": "'active', 'suspended', 'deleted'",
}
_SINGLE = """
    users.user_id stripe_customers.id stripe_customers.user_id stripe_customers.customer_id
    stripe_subscriptions.id stripe_subscriptions.customer_id stripe_orders.id
    user_trials.id user_trials.user_id user_profiles.id
    linked_accounts.id linked_accounts.user_id linked_accounts.external_user_id
    user_account_state.user_id deleted_account_history.id deleted_account_history.email
""".split()
_REFERRING = {
    "stripe_customers.user_id": "users.user_id",
    "stripe_subscriptions.customer_id": "stripe_customers.customer_id",
    "user_trials.user_id": "users.user_id",
    "user_profiles.id": "users.user_id",
    "linked_accounts.user_id": "user_profiles.id",
    "user_account_state.user_id": "user_profiles.id",
}


def _violations() -> str:
    parts = []

    def add(rule: str, table: str, counted: str) -> None:
        parts.append(
            f"SELECT '{rule}' AS rule, '{table}' AS table_name,"
            f" cast(({counted}) AS BIGINT) AS violations"
        )

    def repeats(table: str, key: str) -> str:
        return (
            f"SELECT count(*) FROM (SELECT {key} FROM {table} WHERE {key} IS NOT NULL"
            f" GROUP BY {key} HAVING count(*) > 1)"
        )

    for column in _FILLED:
        table, c = column.split(".")
        add(f"not_null:{c}", table, f"SELECT count(*) FROM {table} WHERE {c} IS NULL")
    for column, listed in _LISTED.items():
        table, c = column.split(".")
        add(f"values:{c}", table, f"SELECT count(*) FROM {table} WHERE {c} NOT IN ({listed})")
    for column in _SINGLE:
        table, c = column.split(".")
        add(f"unique:{c}", table, repeats(table, c))
    for column, parent in _REFERRING.items():
        table, c = column.split(".")
        owner, key = parent.split(".")
        add(
            f"reference:{c}",
            table,
            f"SELECT count(*) FROM {table} WHERE {c} NOT IN (SELECT {key} FROM {owner})",
        )
    return " UNION ALL ".join(parts)


SHARED["violations"] = _violations()

_TRIALS = "user_id, trial_status, deletion_scheduled_at, updated_at"
_BILL_COLUMNS = (
    "subscription_id, price_id, current_period_start, current_period_end,"
    " cancel_at_period_end, payment_method_brand, payment_method_last4"
)
_PRODUCT = "CASE price_id WHEN 'price_pro' THEN 'Go Pro' WHEN 'trial_price' THEN '7-Day Free Trial' END"
_ACCESS = (
    "user_id, trial_start_date, trial_end_date, trial_status, deletion_scheduled_at,"
    " subscription_status, subscription_id, price_id, current_period_end, has_access,"
    " access_type, seconds_remaining, days_remaining"
)


def _converted(condition: str) -> str:
    return (
        f"SELECT user_id, CASE WHEN {condition} THEN 'converted_to_paid' ELSE trial_status END"
        f" AS trial_status, CASE WHEN NOT ({condition}) THEN deletion_scheduled_at END"
        f" AS deletion_scheduled_at, CASE WHEN {condition} THEN {NOW} ELSE updated_at END"
        " AS updated_at FROM flagged"
    )


def _resignup(history: str) -> str:
    return (
        "SELECT s.user_id, h.email IS NOT NULL AS is_returning_user,"
        " h.email IS NOT NULL AS requires_subscription, h.email IS NULL AS trial_allowed,"
        " CASE WHEN h.email IS NULL THEN 'Welcome! Your 7-day free trial has started.'"
        " ELSE 'Welcome back! Please subscribe to continue using our service.' END AS message"
        f" FROM signups s LEFT JOIN {history} h ON h.email = s.email"
    )


def _restored(match: str) -> str:
    return (
        "SELECT r.user_id, CASE WHEN t.user_id IS NOT NULL THEN 'converted_to_paid' END"
        " AS trial_status, CASE WHEN a.user_id IS NOT NULL THEN 'subscription_active' END"
        " AS account_status, CASE WHEN a.user_id IS NOT NULL THEN 'pro' END AS access_level,"
        f" EXISTS (SELECT 1 FROM deleted_account_history h WHERE {match}) AS history_updated"
        " FROM restore_batch r LEFT JOIN user_trials t ON t.user_id = r.user_id"
        " LEFT JOIN user_account_state a ON a.user_id = r.user_id"
    )


_SIGNUP_RESULT = (
    "SELECT s.user_id, s.email, s.full_name,"
    " CASE WHEN h.email IS NULL THEN 'trial_active' ELSE 'trial_expired' END AS account_status,"
    " h.email IS NULL AS has_access,"
    " CASE WHEN h.email IS NULL THEN 'trial' ELSE 'suspended' END AS access_level,"
    " CASE WHEN h.email IS NULL THEN 7 ELSE 0 END AS trial_days_remaining,"
    " s.created_at AS trial_start_date,"
    " CASE WHEN h.email IS NULL THEN s.created_at + INTERVAL '7' DAY ELSE s.created_at END"
    " AS trial_end_date,"
    " CASE WHEN h.email IS NULL THEN 'active' ELSE 'expired' END AS trial_status,"
    " cast(NULL AS TIMESTAMP) AS deletion_scheduled_at"
    " FROM signups s LEFT JOIN known h ON h.email = s.email"
)

_CHANGE_EFFECTS = (
    "SELECT t.user_id, CASE WHEN p.user_id IS NULL THEN trial_status ELSE 'converted_to_paid'"
    " END AS trial_status, CASE WHEN p.user_id IS NULL THEN deletion_scheduled_at END"
    " AS deletion_scheduled_at,"
    f" CASE WHEN p.user_id IS NULL THEN updated_at ELSE {NOW} END AS updated_at"
    " FROM user_trials t LEFT JOIN event_payers p ON p.user_id = t.user_id"
)

_TIMED = (
    "SELECT user_id, trial_status, due_at FROM ("
    "SELECT user_id, 'expired' AS trial_status, trial_end_date AS due_at FROM flagged"
    " WHERE trial_status = 'active' AND NOT safe AND NOT pays UNION ALL"
    " SELECT user_id, 'scheduled_for_deletion', trial_end_date + INTERVAL '1' DAY FROM flagged"
    f" WHERE trial_status = 'active' AND NOT safe AND NOT pays) WHERE due_at < {NOW}"
)

# Access of the users whose subscription an event stream touched.
def _updated_access(touched: str) -> str:
    return (
        "SELECT user_id, has_access, CASE WHEN status = 'active' THEN 'paid_subscription'"
        " WHEN status = 'trialing' THEN 'stripe_trial' WHEN has_access THEN 'free_trial'"
        " ELSE 'no_access' END AS access_type, days_remaining FROM (SELECT k.user_id, c.status,"
        f" cast(k.micros // 86400000000 AS INTEGER) AS days_remaining,"
        f" coalesce(c.status IN {PAYS}, false) OR (k.trial_status = 'active' AND k.micros > 0"
        " AND k.user_id NOT IN (SELECT user_id FROM event_payers)) AS has_access"
        f" FROM {touched} LEFT JOIN (SELECT * FROM merged WHERE deleted_at IS NULL) c"
        " ON c.customer_id = m.customer_id)"
    )


_ACCESS_UPDATES = _updated_access(
    "live_customers m JOIN newest n ON n.customer_id = m.customer_id"
    " JOIN clocked k ON k.user_id = m.user_id"
)
_ACCESS_FEED = _updated_access("clocked k LEFT JOIN live_customers m ON m.user_id = k.user_id")

_MERGED_OUT = (
    "SELECT customer_id, subscription_id, price_id, current_period_start, current_period_end,"
    " cancel_at_period_end, payment_method_brand, payment_method_last4, status, created_at"
    " FROM merged"
)

_METRICS = (
    "SELECT (SELECT count(*) FROM user_profiles) AS total_users,"
    " (SELECT count(*) FROM user_trials WHERE trial_status = 'active') AS active_trials,"
    " (SELECT count(*) FROM stripe_subscriptions WHERE status = 'active')"
    " AS active_subscriptions, (SELECT count(*) FROM linked_accounts) AS linked_accounts,"
    " (SELECT count(*) FROM user_account_state WHERE has_access) AS users_with_access"
)

STATEMENTS = {
    "access_status": f"SELECT {_ACCESS} FROM typed_access",
    "access_level": "SELECT user_id, has_access, access_type,"
    " coalesce(subscription_status, 'none') AS subscription_status, trial_status,"
    " days_remaining FROM typed_access",
    "access_flags": "SELECT user_id,"
    " trial_status = 'active' AND days_remaining > 0 AS is_trial_active,"
    " trial_status = 'expired' OR (trial_status = 'active' AND days_remaining = 0)"
    " AS is_trial_expired, trial_status = 'scheduled_for_deletion' AS is_scheduled_for_deletion,"
    " trial_status = 'converted_to_paid' AS has_converted_to_paid, has_access,"
    " access_type = 'paid_subscription' AS is_paid_user,"
    " access_type = 'stripe_trial' AS is_trialing, access_type = 'free_trial'"
    " AS is_free_trialing, pays OR trial_status = 'converted_to_paid' AS is_protected,"
    " coalesce(subscription_status = 'active', false) AS has_active_subscription,"
    " coalesce(subscription_status = 'trialing', false) AS is_subscription_trialing,"
    " coalesce(subscription_status = 'past_due', false) AS is_past_due,"
    " coalesce(subscription_status = 'canceled', false) AS is_canceled,"
    " CASE access_type WHEN 'paid_subscription' THEN 'PAID SUBSCRIPTION' WHEN 'stripe_trial'"
    " THEN 'STRIPE TRIAL' WHEN 'free_trial' THEN 'FREE TRIAL' ELSE 'NO ACCESS' END"
    " AS access_label FROM typed_access",
    "access_from_views": "SELECT user_id, trial_start_date, trial_end_date, trial_status,"
    " deletion_scheduled_at, s.status AS subscription_status, s.subscription_id, s.price_id,"
    " s.current_period_end, coalesce(s.status IN ('active', 'trialing'), false)"
    " OR (trial_status = 'active' AND a.days_remaining > 0) AS has_access,"
    " CASE WHEN s.status = 'active' THEN 'paid_subscription' WHEN s.status = 'trialing'"
    " THEN 'stripe_trial' WHEN trial_status = 'active' AND a.days_remaining > 0"
    " THEN 'free_trial' ELSE 'no_access' END AS access_type, a.seconds_remaining,"
    " a.days_remaining FROM access a LEFT JOIN strict_bills s USING (user_id)",
    "trial_info": "SELECT user_id, trial_start_date, trial_end_date, trial_status,"
    " deletion_scheduled_at, seconds_remaining, days_remaining FROM access",
    "trial_info_client": "SELECT user_id, trial_start_date, trial_end_date, trial_status,"
    " deletion_scheduled_at, cast(floor(micros / 1000000.0) AS BIGINT) AS seconds_remaining,"
    " cast(ceil(micros / 86400000000.0) AS INTEGER) AS days_remaining FROM clocked",
    "trial_countdown": "SELECT user_id, days, hours, minutes, seconds,"
    " CASE WHEN micros = 0 THEN 'Expired' WHEN days > 0 THEN"
    " format('{}d {}h {}m', days, hours, minutes) WHEN hours > 0 THEN"
    " format('{}h {}m', hours, minutes) ELSE format('{}m', minutes) END AS text,"
    " CASE WHEN subscription_status = 'active' THEN 'premium_active'"
    " WHEN trial_status = 'scheduled_for_deletion' THEN 'deletion_scheduled'"
    " WHEN trial_status = 'expired' THEN 'trial_expired'"
    " WHEN trial_status = 'converted_to_paid' THEN 'none'"
    " WHEN days = 0 THEN 'trial_expired' WHEN days = 1 THEN 'trial_ending_soon'"
    " ELSE 'trial_active' END AS banner,"
    f" CASE WHEN user_id IN {SAFE} THEN 'exempt' WHEN NOT counting THEN 'none'"
    " WHEN left_us <= 0 THEN 'expired' WHEN left_us < 86400000000 THEN 'urgent'"
    " WHEN left_us < 172800000000 THEN 'soon' ELSE 'counting' END AS deletion_banner"
    " FROM (SELECT a.*, days_remaining AS days,"
    " cast(micros // 3600000000 % 24 AS INTEGER) AS hours,"
    " cast(micros // 60000000 % 60 AS INTEGER) AS minutes,"
    " cast(micros // 1000000 % 60 AS INTEGER) AS seconds,"
    " coalesce(x.account_status = 'trial_active' AND x.trial_days_remaining > 0, false)"
    f" AS counting, epoch_us(u.created_at + INTERVAL '7' DAY) - epoch_us({NOW}) AS left_us"
    " FROM access a LEFT JOIN users u ON u.user_id = a.user_id"
    " LEFT JOIN user_account_state x ON x.user_id = a.user_id)",
    "user_subscriptions": "SELECT customer_id, status AS subscription_status,"
    f" {_BILL_COLUMNS}, {_PRODUCT} AS product_name FROM strict_bills",
    "subscription_details": "SELECT user_id, customer_id,"
    " coalesce(status, 'not_started') AS subscription_status, subscription_id, price_id,"
    " current_period_start, current_period_end,"
    " coalesce(cancel_at_period_end, false) AS cancel_at_period_end, payment_method_brand,"
    f" payment_method_last4, {_PRODUCT} AS product_name FROM kept_bills",
    "user_orders": "SELECT c.customer_id, o.id AS order_id, o.checkout_session_id,"
    " o.payment_intent_id, o.amount_subtotal, o.amount_total, o.currency, o.payment_status,"
    " o.status AS order_status, o.created_at AS order_date FROM live_customers c"
    " LEFT JOIN stripe_orders o ON o.customer_id = c.customer_id WHERE o.deleted_at IS NULL",
    "user_overview": "SELECT * FROM overview",
    "overview_access": "SELECT user_id, has_access, CASE WHEN access_level = 'pro'"
    " THEN 'paid_subscription' WHEN access_level = 'trial' THEN 'free_trial'"
    " ELSE 'no_access' END AS access_type,"
    " cast(trial_days_remaining AS BIGINT) * 86400 AS seconds_remaining,"
    " trial_days_remaining AS days_remaining FROM overview",
    "state_flags": "SELECT user_id, coalesce(has_access, false) AS has_access,"
    " coalesce(nullif(access_level, ''), 'trial') AS access_level,"
    " coalesce(access_level = 'pro', false) AS is_paid_user,"
    " coalesce(access_level = 'trial', false) AS is_trial_user,"
    " coalesce(trial_days_remaining, 0) AS days_remaining FROM overview",
    "admin_overview": "SELECT user_id, email, full_name, company, user_created_at AS created_at,"
    " is_active, account_status, has_access, access_level, trial_days_remaining,"
    " user_id IN (SELECT user_id FROM live_customers) AS has_stripe_account,"
    " user_id IN (SELECT user_id FROM linked_accounts) AS has_linked_account,"
    " last_activity_at, external_last_sync, stripe_last_sync FROM overview"
    " JOIN (SELECT id AS user_id, is_active FROM user_profiles) USING (user_id)"
    " LEFT JOIN (SELECT user_id, last_sync_at AS stripe_last_sync FROM live_customers)"
    " USING (user_id)",
    "entitled_rows": "SELECT user_id AS viewer_id, 'stripe_customers' AS table_name,"
    " customer_id AS row_key FROM live_customers"
    " UNION ALL SELECT c.user_id, 'stripe_subscriptions', s.customer_id FROM live_customers c"
    " JOIN live_subscriptions s ON s.customer_id = c.customer_id"
    " UNION ALL SELECT c.user_id, 'stripe_orders', cast(o.id AS VARCHAR) FROM live_customers c"
    " JOIN stripe_orders o ON o.customer_id = c.customer_id WHERE o.deleted_at IS NULL"
    " UNION ALL SELECT user_id, 'user_trials', cast(user_id AS VARCHAR) FROM user_trials"
    " UNION ALL SELECT id, 'user_profiles', cast(id AS VARCHAR) FROM user_profiles"
    " UNION ALL SELECT user_id, 'linked_accounts', cast(user_id AS VARCHAR) FROM linked_accounts"
    " UNION ALL SELECT user_id, 'user_account_state', cast(user_id AS VARCHAR)"
    " FROM user_account_state"
    " UNION ALL SELECT u.user_id, 'deleted_account_history', h.email FROM users u"
    f" JOIN deleted_account_history h ON u.user_id IN {SAFE}",
    "customer_nested": "SELECT customer_id, CASE WHEN status IS NULL THEN '[]' ELSE"
    " cast(to_json([{'subscription_id': subscription_id, 'status': status,"
    " 'price_id': price_id, 'current_period_end': current_period_end}]) AS VARCHAR) END"
    " AS subscriptions FROM (SELECT c.customer_id, s.* EXCLUDE (customer_id)"
    " FROM live_customers c LEFT JOIN stripe_subscriptions s ON s.customer_id = c.customer_id)",
    "change_feed": "SELECT o.user_id, 'UPDATE' AS op, concat_ws(',',"
    " CASE WHEN o.trial_status IS DISTINCT FROM n.trial_status THEN 'trial_status' END,"
    " CASE WHEN o.deletion_scheduled_at IS DISTINCT FROM n.deletion_scheduled_at"
    " THEN 'deletion_scheduled_at' END,"
    " CASE WHEN o.updated_at IS DISTINCT FROM n.updated_at THEN 'updated_at' END)"
    " AS changed_columns FROM user_trials o JOIN step_schedule n ON n.user_id = o.user_id"
    " WHERE o.trial_status IS DISTINCT FROM n.trial_status"
    " OR o.deletion_scheduled_at IS DISTINCT FROM n.deletion_scheduled_at"
    " OR o.updated_at IS DISTINCT FROM n.updated_at",
    "paying_users": "SELECT DISTINCT user_id FROM payers",
    "convert_paying_trials": _converted("pays AND trial_status <> 'converted_to_paid'"),
    "expire_trials": "SELECT user_id, CASE WHEN due THEN 'expired' ELSE trial_status END"
    f" AS trial_status, CASE WHEN due THEN {NOW} + INTERVAL '1' DAY"
    " ELSE deletion_scheduled_at END AS deletion_scheduled_at,"
    f" CASE WHEN due THEN {NOW} ELSE updated_at END AS updated_at FROM (SELECT *,"
    f" trial_status = 'active' AND trial_end_date < {NOW} AND NOT safe AND NOT pays AS due"
    " FROM flagged)",
    "schedule_deletions": "SELECT user_id, CASE WHEN due THEN 'scheduled_for_deletion'"
    " ELSE trial_status END AS trial_status, deletion_scheduled_at,"
    f" CASE WHEN due THEN {NOW} ELSE updated_at END AS updated_at FROM (SELECT *,"
    f" trial_status = 'expired' AND coalesce(deletion_scheduled_at < {NOW}, false)"
    " AND NOT safe AND NOT pays AS due FROM flagged)",
    "protect_paying": _converted(
        "pays AND trial_status IN ('expired', 'scheduled_for_deletion')"
    ),
    "sync_trials": f"SELECT {_TRIALS} FROM step_schedule",
    "check_expired_trials": f"SELECT {_TRIALS} FROM step_schedule",
    "mark_converted": _converted("user_id IN (SELECT user_id FROM restore_batch)"),
    "deletion_candidates": "SELECT f.user_id, u.email, f.trial_end_date FROM flagged f"
    " JOIN users u ON u.user_id = f.user_id WHERE trial_status = 'scheduled_for_deletion'"
    f" AND NOT safe AND NOT pays AND trial_end_date < {NOW} - INTERVAL '1' DAY",
    "deletion_run": "SELECT user_id, email, trial_end_date, CASE WHEN user_id IN"
    " (SELECT user_id FROM payers_after) THEN 'protected' ELSE 'delete' END AS decision"
    " FROM run",
    "deletion_run_report": "SELECT count(*) AS total_candidates,"
    " count(*) FILTER (user_id IN (SELECT user_id FROM payers_after)) AS protected_users,"
    " count(*) FILTER (user_id NOT IN (SELECT user_id FROM payers_after)) AS processed"
    " FROM run",
    "deletion_results": "SELECT user_id, email, email IN (SELECT username FROM"
    " external_directory) AS has_external_account FROM run"
    " WHERE user_id NOT IN (SELECT user_id FROM payers_after)",
    "cleanup_outcomes": "SELECT user_id, email, CASE WHEN pays THEN 'protected' ELSE 'delete'"
    " END AS decision, NOT pays AND email IN (SELECT username FROM external_directory)"
    " AS has_external_account, NOT pays OR email IN (SELECT email FROM deleted_account_history)"
    " AS recorded, pays AS still_a_user FROM (SELECT *,"
    " user_id IN (SELECT user_id FROM payers_after) AS pays FROM run)",
    "purge_users": " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, count(*) FILTER (gone) AS removed,"
        f" count(*) FILTER (NOT gone) AS remaining FROM (SELECT {test} AS gone FROM {table})"
        for table, test in {
            "users": "user_id IN (SELECT user_id FROM doomed)",
            "stripe_customers": "user_id IN (SELECT user_id FROM doomed)",
            "user_trials": "user_id IN (SELECT user_id FROM doomed)",
            "user_profiles": "id IN (SELECT user_id FROM doomed)",
            "linked_accounts": "user_id IN (SELECT user_id FROM doomed)",
            "user_account_state": "user_id IN (SELECT user_id FROM doomed)",
            "stripe_subscriptions": "customer_id IN (SELECT customer_id FROM"
            " stripe_customers WHERE user_id IN (SELECT user_id FROM doomed))",
            "stripe_orders": "customer_id IN (SELECT customer_id FROM"
            " stripe_customers WHERE user_id IN (SELECT user_id FROM doomed))",
        }.items()
    ),
    "timed_transitions": _TIMED,
    "protection_status": "SELECT u.user_id, u.email,"
    " coalesce(b.status IN ('active', 'trialing'), false)"
    " OR coalesce(t.trial_status = 'converted_to_paid', false) AS is_protected,"
    " CASE WHEN b.status = 'active' THEN 'Active paid subscription'"
    " WHEN b.status = 'trialing' THEN 'Stripe trial period'"
    " WHEN t.trial_status = 'converted_to_paid' THEN 'Previously converted to paid'"
    " ELSE 'No protection - eligible for deletion' END AS protection_reason, t.trial_status,"
    " coalesce(b.status, 'none') AS subscription_status FROM users u"
    " LEFT JOIN user_trials t ON t.user_id = u.user_id"
    " LEFT JOIN kept_bills b ON b.user_id = u.user_id",
    "account_state_sync": "SELECT * FROM synced",
    "state_sync_report": "SELECT account_status, access_level, has_access,"
    " grouping(account_status) > 0 AS is_total, count(*) AS profiles_considered,"
    " count(s.user_id) AS states_updated FROM user_profiles p"
    " LEFT JOIN synced s ON s.user_id = p.id WHERE p.is_active GROUP BY GROUPING SETS"
    " ((account_status, access_level, has_access), ())",
    "profile_upsert": "SELECT coalesce(p.id, b.user_id) AS id,"
    " coalesce(b.email, p.email) AS email, coalesce(b.full_name, p.full_name) AS full_name,"
    " p.company, coalesce(p.is_active, true) AS is_active,"
    f" coalesce(p.created_at, {NOW}) AS created_at,"
    f" CASE WHEN b.user_id IS NULL THEN p.updated_at ELSE {NOW} END AS updated_at"
    " FROM user_profiles p FULL JOIN profile_batch b ON b.user_id = p.id",
    "state_provisioning": "SELECT user_id, account_status, has_access, access_level,"
    " trial_start_date, trial_end_date, trial_days_remaining FROM user_account_state"
    f" UNION ALL SELECT user_id, 'trial_active', true, 'trial', {NOW},"
    f" {NOW} + INTERVAL '7' DAY, 7 FROM profile_batch"
    " WHERE user_id NOT IN (SELECT user_id FROM user_account_state)",
    "profile_backfill": "SELECT id, email, full_name, company, is_active, created_at,"
    " updated_at FROM user_profiles UNION ALL SELECT user_id, email, NULL, NULL, true,"
    f" created_at, {NOW} FROM users WHERE user_id NOT IN (SELECT id FROM user_profiles)",
    "linked_account_upsert": "SELECT coalesce(l.user_id, b.user_id) AS user_id,"
    " coalesce(b.external_user_id, l.external_user_id) AS external_user_id,"
    " coalesce(b.external_email, l.external_email) AS external_email,"
    " coalesce(l.account_status, 'active') AS account_status,"
    f" coalesce(l.created_at, {NOW}) AS created_at,"
    f" CASE WHEN b.user_id IS NULL THEN l.updated_at ELSE {NOW} END AS updated_at,"
    f" CASE WHEN b.user_id IS NULL THEN l.last_sync_at ELSE {NOW} END AS last_sync_at"
    " FROM linked_accounts l FULL JOIN link_batch b ON b.user_id = l.user_id",
    "linked_state_update": "SELECT s.user_id,"
    " coalesce(b.external_user_id, s.external_user_id) AS external_user_id,"
    " CASE WHEN b.user_id IS NULL THEN s.external_status ELSE 'active' END AS external_status,"
    f" CASE WHEN b.user_id IS NULL THEN s.updated_at ELSE {NOW} END AS updated_at"
    " FROM user_account_state s LEFT JOIN link_batch b ON b.user_id = s.user_id",
    "customer_link_update": "SELECT c.user_id, c.customer_id,"
    " coalesce(b.email, c.stripe_customer_email) AS stripe_customer_email,"
    f" CASE WHEN b.user_id IS NULL THEN c.last_sync_at ELSE {NOW} END AS last_sync_at,"
    f" CASE WHEN b.user_id IS NULL THEN c.updated_at ELSE {NOW} END AS updated_at"
    " FROM stripe_customers c LEFT JOIN customer_link_batch b"
    " ON b.user_id = c.user_id AND b.customer_id = c.customer_id",
    "customer_link_state": "SELECT s.user_id,"
    " coalesce(b.customer_id, s.stripe_customer_id) AS stripe_customer_id,"
    f" CASE WHEN b.user_id IS NULL THEN s.updated_at ELSE {NOW} END AS updated_at"
    " FROM user_account_state s LEFT JOIN customer_link_batch b ON b.user_id = s.user_id",
    "system_metrics": f"{_METRICS}, {NOW} AS generated_at",
    "system_metrics_json": f"SELECT cast(to_json(m) AS VARCHAR) AS json FROM ({_METRICS}) m",
    "email_trial_history": "SELECT email, trial_used AS has_used_trial,"
    " requires_immediate_subscription AS requires_subscription, ever_subscribed,"
    " deletion_reason, account_deleted_at AS deleted_at FROM deleted_account_history"
    " WHERE email IN (SELECT email FROM signups)",
    "returning_users": "SELECT DISTINCT s.email, h.email IS NOT NULL AS is_returning_user,"
    " coalesce(h.ever_subscribed, false) AS ever_subscribed,"
    " strftime(h.account_deleted_at, '%Y-%m-%d') AS last_deletion,"
    " regexp_replace(h.deletion_reason, '_', ' ') AS deletion_reason,"
    " h.email IS NOT NULL AS subscription_required, CASE WHEN h.email IS NULL"
    " THEN 'Welcome! You''re eligible for a 7-day free trial.' ELSE"
    " 'You''ve already used your free trial. Please subscribe to continue using our service.'"
    " END AS message FROM signups s LEFT JOIN known h ON h.email = s.email",
    "deletion_history_record": _history_after("SELECT user_id, email FROM doomed"),
    "deletion_history_listing": "SELECT original_user_id, email, account_deleted_at,"
    " deletion_reason, ever_subscribed FROM deleted_account_history"
    " ORDER BY account_deleted_at DESC, email",
    "safe_delete_outcomes": "SELECT user_id, email, outcome FROM outcomes",
    "safe_deletes": _history_after(
        "SELECT user_id, email FROM outcomes WHERE outcome = 'recorded'"
    ),
    "resignup_decisions": _resignup("known"),
    "resignup_decisions_strict": _resignup("complete_known"),
    "signup_provisioning": _SIGNUP_RESULT,
    "restore_on_subscription": _restored("h.original_user_id = r.user_id"),
    "restore_on_subscription_by_email": _restored("h.email = r.email"),
    "webhook_routes": "SELECT event_id, route, malformed FROM routed",
    "subscription_upsert": _MERGED_OUT,
    "order_inserts": "SELECT checkout_session_id, payment_intent_id, customer AS customer_id,"
    " amount_subtotal, amount_total, currency, payment_status, 'completed' AS status"
    " FROM first_orders",
    "orders_after": "SELECT checkout_session_id, payment_intent_id, customer_id,"
    " amount_subtotal, amount_total, currency, payment_status, status, created_at"
    " FROM stripe_orders UNION ALL SELECT checkout_session_id, payment_intent_id, customer,"
    " amount_subtotal, amount_total, currency, payment_status, 'completed', created"
    " FROM first_orders WHERE checkout_session_id NOT IN"
    " (SELECT checkout_session_id FROM stripe_orders)",
    "subscription_change_effects": _CHANGE_EFFECTS,
    "checkout_validation": "SELECT event_id, reason FROM reasons",
    "checkout_body_validation": "SELECT event_id, CASE "
    + " ".join(
        f"WHEN coalesce(json_type(body, '$.{p}'), 'NULL') = 'NULL'"
        f" THEN 'Missing required parameter {p}'"
        f" WHEN json_type(body, '$.{p}') <> 'VARCHAR' THEN concat("
        f"'Expected parameter {p} to be a string got ', json_extract(body, '$.{p}'))"
        for p in ("price_id", "success_url", "cancel_url")
    )
    + " WHEN coalesce(json_extract_string(body, '$.mode'), '') NOT IN"
    " ('payment', 'subscription')"
    " THEN 'Expected parameter mode to be one of payment, subscription' END AS reason"
    " FROM checkout_bodies",
    "checkout_provisioning": "SELECT event_id, user_id, action FROM judged",
    "checkout_inserts": "SELECT user_id,"
    " max(coalesce(customer_id, concat('cus_new_', user_id))) AS customer_id,"
    " bool_or(action LIKE 'create_customer%') AS insert_customer,"
    " bool_or(action IN ('create_subscription', 'create_customer_and_subscription'))"
    " AS insert_subscription, 'not_started' AS subscription_status FROM judged"
    " WHERE action LIKE 'create%' GROUP BY user_id",
    "current_plan": "SELECT b.user_id, p.price_id, coalesce(b.price_id = p.price_id"
    " AND b.status IN ('active', 'trialing'), false) AS is_current FROM strict_bills b"
    " JOIN (VALUES ('trial_price'), ('price_pro')) p(price_id) ON true",
    "subscription_label": "SELECT u.user_id, CASE WHEN b.user_id IS NULL"
    " OR b.status = 'not_started' THEN 'NO SUBSCRIPTION' WHEN b.status = 'active'"
    " THEN 'ACTIVE SUBSCRIPTION' WHEN b.status = 'trialing' THEN 'TRIAL PERIOD'"
    " WHEN b.status = 'past_due' THEN 'PAYMENT OVERDUE' WHEN b.status = 'canceled'"
    " THEN 'CANCELED' ELSE 'SUBSCRIPTION STATUS' END AS label,"
    " CASE WHEN b.status = 'active' THEN strftime(make_timestamp(current_period_end * 1000000),"
    " '%Y-%m-%d') END AS renews_on FROM users u LEFT JOIN strict_bills b"
    " ON b.user_id = u.user_id",
    "external_directory_match": "SELECT coalesce(l.email, d.email) AS email,"
    " CASE WHEN d.email IS NULL THEN 'missing_outside' WHEN l.email IS NULL"
    " THEN 'orphan_outside' ELSE 'matched' END AS match_state"
    " FROM (SELECT DISTINCT external_email AS email FROM linked_accounts) l FULL JOIN"
    " (SELECT DISTINCT username AS email FROM external_directory) d ON d.email = l.email",
    "constraint_violations": "SELECT * FROM violations",
    "health_score": "SELECT score, max_score,"
    " cast(round(100 * score / max_score, 2) AS DECIMAL(5, 2)) AS percentage,"
    " CASE WHEN score = max_score THEN 'excellent' WHEN score * 10 >= max_score * 8 THEN 'good'"
    " WHEN score * 10 >= max_score * 6 THEN 'fair' ELSE 'poor' END AS grade, healthy FROM ("
    "SELECT count(*) FILTER (ok) AS score, count(*) AS max_score,"
    " bool_and(ok OR NOT needed) AS healthy FROM ("
    + " UNION ALL ".join(
        f"SELECT EXISTS (SELECT 1 FROM {name}) AS ok, {needed} AS needed"
        for name, needed in {
            "stripe_customers": "true",
            "stripe_subscriptions": "true",
            "stripe_orders": "true",
            "user_trials": "true",
            "user_profiles": "true",
            "linked_accounts": "true",
            "user_account_state": "true",
            "deleted_account_history": "true",
            "strict_bills": "true",
            "access": "true",
            "clocked": "true",
            "overview": "false",
        }.items()
    )
    + " UNION ALL SELECT EXISTS (SELECT 1 FROM live_customers c LEFT JOIN stripe_orders o"
    " ON o.customer_id = c.customer_id WHERE o.deleted_at IS NULL), false"
    " UNION ALL SELECT sum(violations) = 0, false FROM violations"
    " WHERE table_name <> 'users' GROUP BY table_name))",
    # Streams replay their source to the end and must agree with the batch.
    "stream_webhooks": _MERGED_OUT,
    "stream_orders": "SELECT checkout_session_id, payment_intent_id, customer AS customer_id,"
    " amount_subtotal, amount_total, currency, payment_status, 'completed' AS status"
    " FROM first_orders",
    "stream_signups": _SIGNUP_RESULT,
    "stream_subscription_effects": _CHANGE_EFFECTS,
    "stream_synced_trials": "SELECT user_id, CASE WHEN paid THEN 'converted_to_paid'"
    " WHEN open AND lapsed THEN 'expired' WHEN open AND late THEN 'scheduled_for_deletion'"
    " ELSE trial_status END AS trial_status, CASE WHEN paid THEN NULL"
    f" WHEN open AND lapsed THEN {NOW} + INTERVAL '1' DAY ELSE deletion_scheduled_at END"
    " AS deletion_scheduled_at, CASE WHEN paid OR (open AND (lapsed OR late))"
    f" THEN {NOW} ELSE updated_at END AS updated_at FROM (SELECT *,"
    f" trial_status = 'active' AND trial_end_date < {NOW} AS lapsed,"
    f" trial_status = 'expired' AND coalesce(deletion_scheduled_at < {NOW}, false) AS late"
    " FROM judged_after)",
    "stream_access_updates": _ACCESS_UPDATES,
    "stream_access_feed": _ACCESS_FEED,
    # Hours between the start and the end of the feed, the first and the last included.
    "stream_live_access": f"SELECT user_id, has_access, access_type FROM ({_ACCESS_FEED})"
    " WHERE user_id IN (SELECT m.user_id FROM live_customers m JOIN newest n"
    " ON n.customer_id = m.customer_id) OR user_id IN (SELECT user_id FROM user_trials"
    " WHERE date_trunc('hour', trial_end_date) BETWEEN TIMESTAMP '2024-01-26 00:00:00'"
    f" AND {NOW})",
    "stream_trial_access": "SELECT user_id, has_access, access_type, days_remaining"
    " FROM typed_access",
    "stream_trial_timers": _TIMED,
}



def _offenders(renamed: dict[str, str]) -> str:
    """The keys that break a rule, over tables of which some go by another name."""
    parts = []

    def add(rule: str, table: str, key: str, source: str) -> None:
        parts.append(
            f"SELECT '{rule}' AS rule, '{table}' AS table_name, cast({key} AS VARCHAR) AS key,"
            f" count(*) AS rows FROM {source} GROUP BY {key}"
        )

    named = lambda table: renamed.get(table, table)
    for column in _FILLED:
        table, c = column.split(".")
        key = "user_id" if table == "user_account_state" else "id"
        add(f"not_null:{c}", table, key, f"{named(table)} WHERE {c} IS NULL")
    for column, listed in _LISTED.items():
        table, c = column.split(".")
        key = "user_id" if table == "user_account_state" else "id"
        add(f"values:{c}", table, key, f"{named(table)} WHERE {c} NOT IN ({listed})")
    for column in _SINGLE:
        table, c = column.split(".")
        add(f"unique:{c}", table, c, f"{named(table)} WHERE {c} IS NOT NULL")
        parts[-1] += " HAVING count(*) > 1"
    for column, parent in _REFERRING.items():
        table, c = column.split(".")
        owner, key = parent.split(".")
        add(
            f"reference:{c}",
            table,
            c,
            f"{named(table)} WHERE {c} NOT IN (SELECT {key} FROM {named(owner)})",
        )
    return " UNION ALL ".join(parts)


STATEMENTS["product_lookup"] = (
    "SELECT user_id, asked, price_id, product_name, mode, price FROM (SELECT user_id, CASE"
    " user_id % 4 WHEN 0 THEN 'pro_product' WHEN 1 THEN 'trial_product' WHEN 2 THEN 'no_product'"
    " END AS asked FROM users) u LEFT JOIN (VALUES"
    " ('pro_product', 'price_pro', 'Go Pro', 'subscription', 45.00::DECIMAL(10, 2)),"
    " ('trial_product', 'trial_price', '7-Day Free Trial', 'subscription', 0.00::DECIMAL(10, 2)))"
    " p(product_id, price_id, product_name, mode, price) ON p.product_id = u.asked"
)
SHARED["fewer_users"] = "SELECT * FROM users WHERE user_id % 7 <> 0"
SHARED["odd_trials"] = (
    "SELECT * FROM user_trials UNION ALL"
    " SELECT * REPLACE ('odd' AS trial_status) FROM user_trials WHERE user_id % 11 = 0"
)
STATEMENTS["offending_keys"] = _offenders({"users": "fewer_users", "user_trials": "odd_trials"})
_OWN = STATEMENTS["entitled_rows"].rsplit(" UNION ALL ", 1)[0]
STATEMENTS["entitlement_grants"] = (
    f"SELECT viewer_id, table_name, 'row' AS scope, row_key FROM ({_OWN}) UNION ALL"
    f" SELECT user_id, 'deleted_account_history', 'all', NULL FROM users WHERE user_id IN {SAFE}"
)
STATEMENTS["allowed_rows"] = (
    "SELECT DISTINCT viewer_id, table_name, row_key, EXISTS (SELECT 1 FROM"
    f" ({STATEMENTS['entitled_rows']}) e WHERE e.viewer_id = a.viewer_id"
    " AND e.table_name = a.table_name AND e.row_key = a.row_key) AS allowed FROM ("
    "SELECT user_id AS viewer_id, 'user_trials' AS table_name, cast(user_id AS VARCHAR) AS row_key"
    " FROM users UNION ALL SELECT user_id, 'user_trials', cast(user_id + 1 AS VARCHAR) FROM users"
    " UNION ALL SELECT original_user_id % 10, 'deleted_account_history', email"
    " FROM deleted_account_history) a"
)
# Stored as buckets, of which a change touches some: the results are the same.
STATEMENTS["profile_snapshot_upsert"] = STATEMENTS["profile_upsert"]
STATEMENTS["snapshot_change_feed"] = STATEMENTS["change_feed"]

for _name in ("state_sync_report", "health_score"):
    STATEMENTS[f"{_name}_json"] = (
        f"SELECT cast(to_json(m) AS VARCHAR) AS json FROM ({STATEMENTS[_name]}) m"
    )


def oracle_statements() -> dict[str, str]:
    return {name: with_fixtures(sql, SHARED) for name, sql in STATEMENTS.items()}
