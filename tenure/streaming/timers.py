"""Trial expiry as the time moves on, from the trial rows as they are by then."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions import clock
from tenure.model import GRACE_DAYS, SCHEMAS, Tables, struct, with_user_ids
from tenure.operators.keyed import conform
from tenure.plans.access import Protected, flag_protected, paying_users
from tenure.plans.trials import timed_steps
from tenure.sources.manifest import Record
from tenure.sources.tables import MERGE_EVERY, ChangeLog
from tenure.streaming.due import DueIndex, hour_of
from tenure.streaming.run import drain, state_on_disk

C = F.col

_DUE = struct(user_id="long", trial_status="string", due_at="ts")
_TICKED = struct(batch_id="long", before="ts", at="ts")


class TrialTimers:
    """Status changes that fall due as clock ticks move the time on.

    The newest row of each user is filed by the hours of its trial's end and of the end of
    the grace after it, and of all such ends that the user had before. A tick reads the
    hours since the last tick. A row that comes after its end is filed under the last
    tick's hour, and so is one whose user pays or is protected at its time: whoever has
    stopped paying by a later tick is due then.
    """

    def __init__(
        self,
        spark: SparkSession,
        t: Tables,
        protected: Protected,
        root: str,
        grace_days: int = GRACE_DAYS,
        merge_every: int = MERGE_EVERY,
    ):
        self.spark, self.t, self.protected = spark, t, protected
        self.root, self.grace_days = root, grace_days
        kind = t.user_trials.schema["user_id"].dataType
        self._trial = with_user_ids(SCHEMAS["user_trials"], kind)
        self.index = DueIndex(spark, f"{root}/due-hours", self._trial, "user_id", ["updated_at", "id"])
        self._due = ChangeLog(
            spark,
            f"{root}/due",
            with_user_ids(_DUE, kind),
            lambda df: df.drop("batch_id").distinct(),
            merge_every,
        )
        self._ticked = Record(spark, f"{root}/ticked", _TICKED)

    def run(self, trials: DataFrame, clock_ticks: DataFrame) -> "TrialTimers":
        """Take the rows that ``trials`` holds, then the ticks (``at``).

        The state per user is the newest row and the hours that the user was filed under.
        """
        rest = [c for c in self._trial.names if c != "user_id"]
        # Of rows of one update, that of the later batch is the newest.
        order = F.struct("updated_at", "_came", "id")
        newest = trials.withColumn("_came", F.current_timestamp()).groupBy("user_id").agg(
            F.max_by(F.struct(*rest), order).alias("row"),
            F.flatten(F.collect_set(F.array(*self._hours()))).alias("hours"),
        )
        with state_on_disk(self.spark):
            drain(newest, self._file, f"{self.root}/trials-checkpoint", mode="update")
        drain(clock_ticks, self._tick, f"{self.root}/checkpoint")
        return self

    def _hours(self):
        end = C("trial_end_date")
        return hour_of(end), hour_of(end + clock.days(self.grace_days))

    def _now(self) -> datetime | None:
        last = self._ticked.read()
        return last["at"] if last else None

    def _file(self, batch: DataFrame, batch_id: int) -> None:
        now = self._now()
        hours = C("hours")
        if now is not None:
            # What should have been seen by now is seen at the next tick.
            hours = F.transform(hours, lambda h: F.greatest(h, F.lit(f"{now:%Y-%m-%d-%H}")))
        self.index.file(batch.select("user_id", "row.*", "hours"), hours, 2 * batch_id)

    def _tick(self, batch: DataFrame, batch_id: int) -> None:
        at = batch.agg(F.max("at")).first()[0]
        last = self._ticked.read()
        # A replayed tick starts where it started first.
        before = (last["before"] if last["batch_id"] == batch_id else last["at"]) if last else None
        if at is None or (before is not None and at < before):
            return
        found = self.index.read(before, at)
        payers = paying_users(self.t).withColumn("_pays", F.lit(True))
        judged = flag_protected(found.join(payers, "user_id", "left"), self.protected)
        now = clock.instant(at)
        # Read twice, and the index is written to in between.
        running = judged.filter((C("trial_status") == "active") & (C("trial_end_date") < now)).persist()
        try:
            spared = F.coalesce("_pays", C("_safe"))
            due = running.filter(~spared).select("user_id", F.inline(timed_steps(self.grace_days)))
            self._due.write(due.filter(C("due_at") < now), batch_id)
            waiting = conform(running.filter(spared), self._trial)
            self.index.file(waiting, F.array(F.lit(f"{at:%Y-%m-%d-%H}")), 2 * batch_id + 1)
        finally:
            running.unpersist()
        self._ticked.write(batch_id=batch_id, before=before, at=at)

    def due(self) -> DataFrame:
        """All status changes so far: user_id, trial_status, due_at."""
        return self._due.read().select(*_DUE.names).distinct()


def run_trial_timers(
    spark: SparkSession,
    trials: DataFrame,
    clock_ticks: DataFrame,
    t: Tables,
    protected: Protected,
    root: str,
    grace_days: int = GRACE_DAYS,
) -> DataFrame:
    """Status changes (user_id, trial_status, due_at) that have fallen due.

    ``trials`` streams trial rows, ``clock_ticks`` rows (``at``) that move the
    time on. A user's row is the one updated last, so an extended trial falls due
    at its new end and a converted one never does. No row is late: a trial that
    comes after its end is due at the next tick. Who pays by then is left alone.
    """
    return TrialTimers(spark, t, protected, root, grace_days).run(trials, clock_ticks).due()
