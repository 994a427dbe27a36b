"""New accounts as a stream: profile, state and trial of each signup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenure.model import Tables, struct, with_user_ids
from tenure.operators.keyed import extreme_per_key
from tenure.plans import accounts
from tenure.sources.tables import MERGE_EVERY, ChangeLog
from tenure.streaming.run import drain

_LOG = struct(
    user_id="long", email="string", full_name="string", created_at="ts", event_id="long"
)
_ORDER = ("created_at", "event_id")


def _first_signups(rows: DataFrame) -> DataFrame:
    return extreme_per_key(rows, ["user_id"], _ORDER, newest=False)


class SignupStream:
    """The accounts that a stream of signups has created.

    The first signup of a user counts, so replays and repeats change nothing.
    """

    def __init__(
        self, spark: SparkSession, t: Tables, root: str, merge_every: int = MERGE_EVERY
    ):
        self.t, self.root = t, root
        kind = t.user_profiles.schema["id"].dataType
        self._signups = ChangeLog(
            spark, f"{root}/signups", with_user_ids(_LOG, kind), _first_signups, merge_every
        )

    def _take(self, batch: DataFrame, batch_id: int) -> None:
        self._signups.write(_first_signups(batch.select(*_LOG.names)), batch_id)

    def run(self, signups: DataFrame) -> "SignupStream":
        drain(signups, self._take, f"{self.root}/checkpoint")
        return self

    def signups(self) -> DataFrame:
        return _first_signups(self._signups.read().drop("batch_id"))

    def provisioned(self) -> DataFrame:
        return accounts.signup_provisioning(self.t, self.signups())

    def tables(self) -> Tables:
        return accounts.apply_signups(self.t, self.signups())
