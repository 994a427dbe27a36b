"""Access kept up to date while billing events and trial changes come in.

Both kinds of change meet in one stateful aggregate that holds, per user, the
newest subscription, whether an event made the user a payer, and the trial row
updated last. So each refresh sees both, whichever has changed. In update mode a
batch brings only the users it changed. The changed rows are written out first
and read back, since they are used more than once; the refreshed access rows go
to one log. Each refresh reads the touched users' rows of the base tables, whose
scans bucketed tables spare the shuffle.

With a stream of clock ticks the time moves on as well, and a user whose trial ends
between two ticks is refreshed without an event. Users are filed by the hours of their trials' ends
(see ``DueIndex``), so a tick reads the hours since the last one.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tenure.functions import clock
from tenure.model import PAYING_STATUSES, SCHEMAS, Tables, struct, with_user_ids
from tenure.operators.keyed import conform, extreme_per_key
from tenure.plans import access, billing
from tenure.sources.manifest import Record
from tenure.sources.snapshots import StoredTables
from tenure.sources.tables import MERGE_EVERY, ChangeLog
from tenure.streaming.due import DueIndex, hour_of
from tenure.streaming.run import drain, keep_running, state_on_disk
from tenure.streaming.webhooks import SUBSCRIPTION_LOG

C = F.col

_LOG = struct(user_id="long", has_access="boolean", access_type="string", days_remaining="int")
_CLOCK = struct(batch_id="long", before="ts", at="ts")


def wall_clock(spark: SparkSession) -> DataFrame:
    """A stream of ticks (``at``), the current time in UTC, one a second at most."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    utc = F.to_utc_timestamp("timestamp", F.current_timezone())
    return ticks.select(utc.cast("timestamp_ntz").alias("at"))


class AccessFeed:
    """The access of the users that billing events or trial changes touch.

    A user has one live customer, as the tables declare. A trial row from the
    stream stands in place of the stored one. Access is judged at ``as_of``, or, with
    ticks, at the time of the last tick. With ``stored`` tables, a batch reads of the base
    tables the buckets of its users alone.
    """

    def __init__(
        self,
        spark: SparkSession,
        t: Tables,
        as_of: clock.Instant,
        root: str,
        merge_every: int = MERGE_EVERY,
        stored: StoredTables | None = None,
    ):
        self.spark, self.t, self.as_of, self.root = spark, t, as_of, root
        self._stored = stored
        kind = t.user_trials.schema["user_id"].dataType
        trial = T.StructType([f for f in SCHEMAS["user_trials"] if f.name != "user_id"])
        sub = T.StructType([f for f in SUBSCRIPTION_LOG if f.name != "customer_id"])
        user = [T.StructField("user_id", kind), T.StructField("customer_id", T.StringType())]
        tick = T.StructField("at", T.TimestampNTZType())
        self._change = T.StructType([*user, *sub, T.StructField("trial", trial), tick])
        newest = [
            *user,
            T.StructField("sub", sub),
            T.StructField("ever_paid", T.BooleanType()),
            T.StructField("trial", trial),
        ]
        self._state = T.StructType(newest)
        known = [T.StructField("ends", T.ArrayType(T.StringType())), tick]
        self._changes = ChangeLog(spark, f"{root}/changes", T.StructType([*newest, *known]))
        self._log = ChangeLog(
            spark,
            f"{root}/access",
            with_user_ids(_LOG, kind),
            lambda df: extreme_per_key(df, ["user_id"], ["batch_id"]),
            merge_every,
        )
        self._clock = Record(spark, f"{root}/clock", _CLOCK)
        self._wakes = DueIndex(spark, f"{root}/wakes", self._state, "user_id")

    def run(
        self, events: DataFrame | None = None, trials: DataFrame | None = None
    ) -> "AccessFeed":
        """Take all that the given streams hold, in one query."""
        with state_on_disk(self.spark):
            drain(self._newest(events, trials), self._take, f"{self.root}/checkpoint", mode="update")
        return self

    def start(
        self,
        ticks: DataFrame,
        events: DataFrame | None = None,
        trials: DataFrame | None = None,
        every: str = "10 seconds",
    ) -> StreamingQuery:
        """One query that runs on, a batch ``every`` so often, until it is stopped.

        Each batch takes what has come from all streams. Started again with the same
        root, it goes on at the time and the state that it had reached.
        """
        if self._clock.read() is None:
            # The stored trials, once; a later start finds the clock's record.
            ends = self.t.user_trials.select("user_id", hour_of(C("trial_end_date")).alias("end"))
            self._wakes.file(conform(ends, self._filed()), F.array("end"), -1)
            at = self.spark.range(1).select(clock.instant(self.as_of)).first()[0]
            self._clock.write(batch_id=-1, before=at, at=at)
        newest = self._newest(events, trials, ticks)
        with state_on_disk(self.spark):
            return keep_running(newest, self._take, f"{self.root}/checkpoint", "update", every)

    def _newest(
        self, events: DataFrame | None, trials: DataFrame | None, ticks: DataFrame | None = None
    ) -> DataFrame:
        """Per user the newest of both kinds of change; ticks have no user."""
        parts = []
        if events is not None:
            owners = access.live(self.t.stripe_customers).select("user_id", "customer_id")
            parts.append(billing.sync_candidates(events).join(owners, "customer_id"))
        if trials is not None:
            rest = [c for c in SCHEMAS["user_trials"].names if c != "user_id"]
            parts.append(trials.select("user_id", F.struct(*rest).alias("trial")))
        if ticks is not None:
            parts.append(ticks.select("at"))
        changes = reduce(DataFrame.unionByName, [conform(p, self._change) for p in parts])
        return changes.groupBy("user_id").agg(
            F.max("customer_id").alias("customer_id"),
            billing.newest_candidate(changes.drop("user_id", "trial", "at")).alias("sub"),
            F.coalesce(F.bool_or(C("status").isin(*PAYING_STATUSES)), F.lit(False)).alias(
                "ever_paid"
            ),
            F.max_by(
                "trial", F.when(C("trial").isNotNull(), F.struct("trial.updated_at", "trial.id"))
            ).alias("trial"),
            F.collect_set(hour_of(C("trial.trial_end_date"))).alias("ends"),
            F.max("at").alias("at"),
        )

    def _filed(self) -> T.StructType:
        return T.StructType([*self._state.fields, T.StructField("end", T.StringType())])

    def _take(self, batch: DataFrame, batch_id: int) -> None:
        self._changes.write(batch, batch_id)
        changed = self._changes.read_batch(batch_id)
        last = self._clock.read()
        if last is None:  # a feed without a clock
            touched, now = changed.select(self._state.names), self.as_of
        else:
            # A replayed batch starts where it started first.
            before = last["before"] if last["batch_id"] == batch_id else last["at"]
            tick = changed.filter("user_id IS NULL").agg(F.max("at")).first()[0]
            now = max(before, tick) if tick is not None else before
            changed = changed.filter("user_id IS NOT NULL")
            touched = self._with_woken(changed, before, now)
        self._log.write(access.access_status(self._refresh(touched), now), batch_id)
        if last is not None:
            self._file(changed, batch_id)
            self._clock.write(batch_id=batch_id, before=before, at=now)

    def _with_woken(self, changed: DataFrame, before: datetime, now: datetime) -> DataFrame:
        """The changed users, and those whose trial ends since the last tick."""
        rows = changed.select(self._state.names)
        if now == before:
            return rows
        woken = self._wakes.read(before, now).join(rows, "user_id", "left_anti")
        return rows.unionByName(woken)

    def _file(self, changed: DataFrame, batch_id: int) -> None:
        """File the changed users under all ends that their trials, stored or given, ever had."""
        base = self._base(changed.select("user_id")).user_trials
        stored = base.select("user_id", hour_of(C("trial_end_date")).alias("_stored"))
        known = changed.join(stored, "user_id", "left")
        self._wakes.file(known, F.concat(F.array("_stored"), "ends"), batch_id)

    def _base(self, users: DataFrame) -> Tables:
        return self.t if self._stored is None else self._stored.of_users(self.t, users)

    def _refresh(self, changed: DataFrame) -> Tables:
        """The tables as they are by now, cut down to the changed users."""
        users = changed.select("user_id")
        base = self._base(users)
        customers = base.stripe_customers.join(users, "user_id", "left_semi")
        billed = changed.filter("customer_id IS NOT NULL")
        before = base.stripe_subscriptions.join(
            customers.select("customer_id"), "customer_id", "left_semi"
        )
        stored = base.user_trials.join(changed.filter("trial IS NULL"), "user_id", "left_semi")
        given = changed.filter("trial IS NOT NULL").select("user_id", "trial.*")
        now = base.replace(
            stripe_customers=customers,
            stripe_subscriptions=billing.merge_subscriptions(
                before, billed.select("customer_id", "sub.*"), self.as_of
            ),
            user_trials=stored.unionByName(given),
        )
        payers = billed.filter("ever_paid").select("customer_id", F.lit("active").alias("status"))
        return now.replace(
            user_trials=billing.subscription_change_effects(now, payers, self.as_of)
        )

    def latest(self) -> DataFrame:
        """Each touched user's access as last updated."""
        rows = extreme_per_key(self._log.read(), ["user_id"], ["batch_id"])
        return rows.drop("batch_id")
