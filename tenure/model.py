"""The data model: table schemas, fixed values and the ``Tables`` record."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values -------------------------------------------------------------
# Allowed values of the enumerated columns.
SUBSCRIPTION_STATUSES = (
    "not_started",
    "incomplete",
    "incomplete_expired",
    "trialing",
    "active",
    "past_due",
    "canceled",
    "unpaid",
    "paused",
)
ORDER_STATUSES = ("pending", "completed", "canceled")
TRIAL_STATUSES = ("active", "expired", "converted_to_paid", "scheduled_for_deletion")
ACCOUNT_STATUSES = (
    "trial_active",
    "trial_expired",
    "subscription_active",
    "subscription_trialing",
    "subscription_past_due",
    "subscription_canceled",
    "account_suspended",
    "account_deleted",
)
ACCESS_LEVELS = ("trial", "pro", "enterprise", "suspended")
LINK_STATUSES = ("active", "suspended", "deleted")

# A subscription in one of these states pays for access.
PAYING_STATUSES = ("active", "trialing")

TRIAL_DAYS = 7
GRACE_DAYS = 1
# ---------------------------------------------------------------------------

_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "double": T.DoubleType(),
    # Instants are UTC wall-clock values without a zone, so that results do
    # not depend on the session time zone.
    "ts": T.TimestampNTZType(),
}


def struct(**columns: str) -> T.StructType:
    """A ``StructType`` from ``name="type"`` pairs."""
    return T.StructType([T.StructField(n, _TYPES[t], True) for n, t in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "users": struct(user_id="long", email="string", full_name="string", created_at="ts"),
    "stripe_customers": struct(
        id="long",
        user_id="long",
        customer_id="string",
        stripe_customer_email="string",
        last_sync_at="ts",
        sync_errors="string",
        created_at="ts",
        updated_at="ts",
        deleted_at="ts",
    ),
    "stripe_subscriptions": struct(
        id="long",
        customer_id="string",
        subscription_id="string",
        price_id="string",
        current_period_start="long",
        current_period_end="long",
        cancel_at_period_end="boolean",
        payment_method_brand="string",
        payment_method_last4="string",
        status="string",
        created_at="ts",
        updated_at="ts",
        deleted_at="ts",
    ),
    "stripe_orders": struct(
        id="long",
        checkout_session_id="string",
        payment_intent_id="string",
        customer_id="string",
        amount_subtotal="long",
        amount_total="long",
        currency="string",
        payment_status="string",
        status="string",
        created_at="ts",
        updated_at="ts",
        deleted_at="ts",
    ),
    "user_trials": struct(
        id="long",
        user_id="long",
        trial_start_date="ts",
        trial_end_date="ts",
        trial_status="string",
        deletion_scheduled_at="ts",
        created_at="ts",
        updated_at="ts",
    ),
    "user_profiles": struct(
        id="long",
        email="string",
        full_name="string",
        avatar_url="string",
        phone="string",
        company="string",
        created_at="ts",
        updated_at="ts",
        last_login_at="ts",
        is_active="boolean",
        metadata="string",
    ),
    "linked_accounts": struct(
        id="long",
        user_id="long",
        external_user_id="string",
        external_email="string",
        account_status="string",
        created_at="ts",
        updated_at="ts",
        last_sync_at="ts",
        sync_errors="string",
    ),
    "user_account_state": struct(
        user_id="long",
        account_status="string",
        has_access="boolean",
        access_level="string",
        trial_start_date="ts",
        trial_end_date="ts",
        trial_days_remaining="int",
        stripe_customer_id="string",
        stripe_subscription_id="string",
        subscription_status="string",
        current_period_end="ts",
        external_user_id="string",
        external_status="string",
        created_at="ts",
        updated_at="ts",
        last_activity_at="ts",
        notes="string",
        admin_flags="string",
    ),
    "deleted_account_history": struct(
        id="string",
        original_user_id="long",
        email="string",
        full_name="string",
        trial_used="boolean",
        trial_start_date="ts",
        trial_end_date="ts",
        trial_completed="boolean",
        ever_subscribed="boolean",
        last_subscription_status="string",
        subscription_cancelled_date="ts",
        account_deleted_at="ts",
        deletion_reason="string",
        can_get_new_trial="boolean",
        requires_immediate_subscription="boolean",
        created_at="ts",
        updated_at="ts",
    ),
    "webhook_events": struct(
        event_id="string",
        type="string",
        created="ts",
        malformed="string",
        customer="string",
        mode="string",
        payment_status="string",
        invoice="string",
        checkout_session_id="string",
        payment_intent_id="string",
        amount_subtotal="long",
        amount_total="long",
        currency="string",
        subscription_id="string",
        subscription_status="string",
        subscription_created="ts",
        price_id="string",
        current_period_start="long",
        current_period_end="long",
        cancel_at_period_end="boolean",
        payment_method_given="boolean",
        payment_method_brand="string",
        payment_method_last4="string",
    ),
    "external_directory": struct(
        id="string", username="string", is_active="boolean", is_superuser="boolean"
    ),
}

# Columns beside ``user_id`` that hold a user's id.
_USER_IDS = {("user_profiles", "id"), ("deleted_account_history", "original_user_id")}


def with_user_ids(schema: T.StructType, kind: T.DataType, name: str = "") -> T.StructType:
    """The schema, of table ``name`` if it is one, with user ids of the given type.

    The derived tables number their users; real tables identify them by text.
    """
    return T.StructType(
        [
            T.StructField(f.name, kind, f.nullable)
            if f.name == "user_id" or (name, f.name) in _USER_IDS
            else f
            for f in schema.fields
        ]
    )


# The tables that the rules guard; ``users`` belongs to the sign-in platform.
CORE_TABLES = (
    "stripe_customers",
    "stripe_subscriptions",
    "stripe_orders",
    "user_trials",
    "user_profiles",
    "linked_accounts",
    "user_account_state",
    "deleted_account_history",
)


class Tables:
    """A lazy record of table DataFrames, read as attributes.

    ``loader(name)`` is called at most once per table, so a query touches only
    the tables it uses. ``tables.replace(user_trials=df)`` gives a record in
    which some tables are replaced by their next snapshot.
    """

    def __init__(
        self,
        loader: Callable[[str], DataFrame],
        names: Iterable[str] = tuple(SCHEMAS),
        _known: Mapping[str, DataFrame] | None = None,
    ):
        self._loader = loader
        self._known = dict(_known or {})
        self.names = tuple(dict.fromkeys((*names, *self._known)))

    @classmethod
    def of(cls, **frames: DataFrame) -> "Tables":
        def missing(name: str) -> DataFrame:
            raise KeyError(f"table {name!r} was not given")

        return cls(missing, names=(), _known=frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name == "names":
            raise AttributeError(name)
        if name not in self._known:
            if name not in self.names:
                raise AttributeError(f"no table named {name!r}")
            self._known[name] = self._loader(name)
        return self._known[name]

    def __contains__(self, name: str) -> bool:
        return name in self.names

    def replace(self, **frames: DataFrame) -> "Tables":
        return Tables(self._loader, self.names, {**self._known, **frames})
