"""Small hand-written tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from tenure.model import CORE_TABLES, SCHEMAS, Tables

AS_OF = datetime(2024, 1, 31)
DAY = timedelta(days=1)


def frame(spark, name, rows, schema=None):
    schema = schema or SCHEMAS[name]
    full = [tuple(r.get(f.name) for f in schema) for r in rows]
    return spark.createDataFrame(full, schema)


def user(user_id, **more):
    return {
        "user_id": user_id,
        "email": f"u{user_id}@example.com",
        "created_at": AS_OF - 10 * DAY,
        **more,
    }


def trial(user_id, status="active", end=AS_OF + 3 * DAY, scheduled=None, **more):
    return {
        "id": user_id,
        "user_id": user_id,
        "trial_start_date": end - 7 * DAY,
        "trial_end_date": end,
        "trial_status": status,
        "deletion_scheduled_at": scheduled,
        "created_at": end - 7 * DAY,
        "updated_at": end - 7 * DAY,
        **more,
    }


def customer(user_id, deleted=False, **more):
    return {
        "id": user_id,
        "user_id": user_id,
        "customer_id": f"cus_{user_id}",
        "deleted_at": AS_OF - DAY if deleted else None,
        **more,
    }


def subscription(user_id, status="active", deleted=False, **more):
    return {
        "id": user_id,
        "customer_id": f"cus_{user_id}",
        "subscription_id": f"sub_{user_id}",
        "price_id": "price_pro",
        "current_period_start": 1704067200,
        "current_period_end": 1706659200,
        "cancel_at_period_end": False,
        "status": status,
        "deleted_at": AS_OF - DAY if deleted else None,
        **more,
    }


def profile(user_id, **more):
    return {
        "id": user_id,
        "email": f"u{user_id}@example.com",
        "full_name": f"User {user_id}",
        "is_active": True,
        "created_at": AS_OF - 10 * DAY,
        **more,
    }


def state(user_id, **more):
    return {
        "user_id": user_id,
        "account_status": "trial_active",
        "has_access": True,
        "access_level": "trial",
        "trial_days_remaining": 7,
        **more,
    }


def history(email, original_user_id=1, **more):
    return {
        "id": f"h_{email}",
        "original_user_id": original_user_id,
        "email": email,
        "trial_used": True,
        "trial_completed": False,
        "ever_subscribed": False,
        "account_deleted_at": AS_OF - 40 * DAY,
        "deletion_reason": "trial_expired",
        "can_get_new_trial": False,
        "requires_immediate_subscription": True,
        **more,
    }


def tables(spark, **rows) -> Tables:
    names = dict.fromkeys(("users", *CORE_TABLES, *rows))
    return Tables.of(**{n: frame(spark, n, rows.get(n, [])) for n in names})


def by(df, key="user_id"):
    rows = df.collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows), f"{key} is not unique"
    return out
