"""Streams over repeated, shuffled files end where the batch query ends."""

import random

import pytest
from compare import spark_rows

from tenure.catalog import STREAMS, SUBSCRIPTION_VIEW
from tenure.functions import clock
from tenure.model import SCHEMAS, struct, with_user_ids
from tenure.plans import access, accounts, billing, trials
from tenure.session import shared_dir
from tenure.sources.derived import AS_OF, PROTECTED_IDS, derived_stream, derived_tables
from tenure.operators.keyed import extreme_per_key
from tenure.sources.manifest import Record
from tenure.sources.snapshots import StoredTables
from tenure.sources.tables import ChangeLog, read_stream
from tenure.streaming.access import AccessFeed
from tenure.streaming.signups import SignupStream
from tenure.streaming.timers import TrialTimers, run_trial_timers
from tenure.streaming.webhooks import WebhookStream


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return derived_tables(spark, sf_dir)


@pytest.fixture(scope="module")
def shuffled(spark, sf_dir, tmp_path_factory):
    """The events in seven files of random order, a third of them twice."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    root = tmp_path_factory.mktemp("shuffled")
    rows = pq.read_table(f"{sf_dir}/events.parquet").to_pylist()
    schema = pq.read_schema(f"{sf_dir}/events.parquet").remove_metadata()
    rows += rows[::3]
    random.Random(7).shuffle(rows)
    for i in range(7):
        pq.write_table(pa.Table.from_pylist(rows[i::7], schema), root / f"events-{i}.parquet")
    return str(root)


def stream(spark, root, name):
    return derived_stream(spark, root, name, files_per_batch=2)


@pytest.mark.parametrize("dedupe_within", [None, "60 days"])
def test_webhooks(spark, t, shuffled, dedupe_within):
    run = WebhookStream(spark, t, AS_OF, shared_dir(spark, "test"))
    run.run(stream(spark, shuffled, "webhook_events"), dedupe_within)
    batch = billing.subscription_upsert(t, t.webhook_events, AS_OF)
    view = [c for c in batch.columns if c != "id"]
    assert spark_rows(run.subscriptions().select(*view)) == spark_rows(batch.select(*view))
    orders = billing.order_inserts(t.webhook_events)
    assert spark_rows(run.new_orders().select(*orders.columns)) == spark_rows(orders)
    changed = billing.subscription_changes(t.webhook_events)
    effects = billing.subscription_change_effects(t, changed, AS_OF)
    assert spark_rows(run.trials()) == spark_rows(effects)
    after = t.replace(stripe_subscriptions=batch, user_trials=effects)
    synced = trials.sync_trials(after, AS_OF, PROTECTED_IDS)
    assert spark_rows(run.synced_trials(PROTECTED_IDS)) == spark_rows(synced)
    assert run.orders().count() == billing.orders_after(t, t.webhook_events).count()


def test_a_second_run_resumes_where_the_first_stopped(spark, t, shuffled):
    root = shared_dir(spark, "test")
    first = WebhookStream(spark, t, AS_OF, root).run(stream(spark, shuffled, "webhook_events"))
    before = spark_rows(first.subscriptions().select(*SUBSCRIPTION_VIEW))
    again = WebhookStream(spark, t, AS_OF, root).run(stream(spark, shuffled, "webhook_events"))
    assert spark_rows(again.subscriptions().select(*SUBSCRIPTION_VIEW)) == before


def test_a_replayed_batch_counts_once(spark, t):
    run = WebhookStream(spark, t, AS_OF, shared_dir(spark, "test"))
    for batch_id in (0, 1, 1, 0):
        run._take(t.webhook_events, batch_id)
    batch = billing.subscription_upsert(t, t.webhook_events, AS_OF)
    assert spark_rows(run.subscriptions().select(*SUBSCRIPTION_VIEW)) == spark_rows(
        batch.select(*SUBSCRIPTION_VIEW)
    )


def test_access_updates(spark, t, shuffled):
    run = AccessFeed(spark, t, AS_OF, shared_dir(spark, "test"))
    run.run(stream(spark, shuffled, "webhook_events"))
    events = t.webhook_events
    effects = billing.subscription_change_effects(t, billing.subscription_changes(events), AS_OF)
    after = t.replace(
        stripe_subscriptions=billing.subscription_upsert(t, events, AS_OF), user_trials=effects
    )
    touched = access.live(t.stripe_customers).join(
        billing.newest_subscriptions(events), "customer_id", "left_semi"
    )
    batch = access.access_status(after, AS_OF).join(
        touched.select("user_id"), "user_id", "left_semi"
    )
    latest = run.latest()
    assert spark_rows(latest) == spark_rows(batch.select(*latest.columns))


def test_access_follows_the_trial_row_updated_last(spark, tmp_path):
    from hand import DAY, by, frame, tables, trial
    from hand import AS_OF as NOW

    t = tables(spark)
    changes = [
        [trial(1, updated_at=NOW), trial(2, updated_at=NOW - DAY)],
        [trial(1, "expired", updated_at=NOW - DAY), trial(2, "expired", updated_at=NOW)],
    ]
    root, files = shared_dir(spark, "test"), str(tmp_path)
    for rows in changes:
        frame(spark, "user_trials", rows).coalesce(1).write.mode("append").parquet(files)
        updates = AccessFeed(spark, t, NOW, root)
        updates.run(trials=read_stream(spark, files, SCHEMAS["user_trials"]))
    rows = by(updates.latest())
    assert rows[1].access_type == "free_trial" and not rows[2].has_access


def test_one_feed_sees_both_changes_of_a_user(spark, tmp_path):
    """Text ids; a payment and the trial's end come in either order, for one user each."""
    from hand import AS_OF as NOW
    from hand import DAY, by, customer, frame, tables, trial
    from pyspark.sql import types as T

    def typed(name):
        return with_user_ids(SCHEMAS[name], T.StringType(), name)

    users = ["uuid-a", "uuid-b", "uuid-c"]
    given = {
        "stripe_customers": [customer(u, id=i) for i, u in enumerate(users)],
        "user_trials": [trial(u, id=i) for i, u in enumerate(users)],
    }
    stored = {n: frame(spark, n, rows, typed(n)) for n, rows in given.items()}
    t = tables(spark).replace(**stored)

    def ended(i):
        return ("user_trials", trial(users[i], "expired", NOW - DAY, updated_at=NOW, id=i))

    def paid(i):
        event = {
            "event_id": f"evt_{i}",
            "type": "customer.subscription.updated",
            "created": NOW,
            "customer": f"cus_{users[i]}",
            "subscription_id": f"sub_{i}",
            "subscription_status": "active",
        }
        return ("webhook_events", event)

    root, files = shared_dir(spark, "test"), str(tmp_path)
    for step in ([paid(0), ended(1), ended(2)], [ended(0), paid(1)]):
        for name in ("webhook_events", "user_trials"):
            rows = [row for kind, row in step if kind == name]
            batch = frame(spark, name, rows, typed(name))
            batch.coalesce(1).write.mode("append").parquet(f"{files}/{name}")
        feed = AccessFeed(spark, t, NOW, root)
        feed.run(*(read_stream(spark, f"{files}/{n}", typed(n)) for n in ("webhook_events", "user_trials")))
    rows = by(feed.latest())
    assert {u: r.access_type for u, r in rows.items()} == {
        "uuid-a": "paid_subscription",
        "uuid-b": "paid_subscription",
        "uuid-c": "no_access",
    }


def test_signups(spark, t, shuffled):
    run = SignupStream(spark, t, shared_dir(spark, "test"))
    run.run(stream(spark, shuffled, "signups"))
    batch = accounts.signup_provisioning(t, t.signups)
    assert spark_rows(run.provisioned()) == spark_rows(batch)
    made = run.tables().user_trials
    assert made.count() == t.user_trials.count() + t.signups.count()


def test_trial_timers_fire_once_and_late_trials_too(spark, t, sf_dir, tmp_path):
    """Ticks move the time in steps; half of the trials come after the end."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{sf_dir}/customer.parquet").to_pylist()
    schema = pq.read_schema(f"{sf_dir}/customer.parquet").remove_metadata()
    root, files, ticks = shared_dir(spark, "test"), tmp_path / "trials", f"{tmp_path}/ticks"
    files.mkdir()

    def step(i, at, part):
        pq.write_table(pa.Table.from_pylist(part, schema), files / f"customer-{i}.parquet")
        spark.range(1).select(clock.instant(at).alias("at")).write.mode("append").parquet(ticks)
        return run_trial_timers(
            spark,
            derived_stream(spark, str(files), "user_trials"),
            read_stream(spark, ticks, struct(at="ts")),
            t,
            PROTECTED_IDS,
            root,
        )

    early = step(0, "2024-01-20 00:00:00", rows[::2])
    assert early.filter("due_at > timestamp_ntz'2024-01-20 00:00:00'").count() == 0
    before = early.count()
    assert 0 < before
    late = step(1, AS_OF, [*rows[1::2], *rows[:20:2]])
    expected = trials.timed_transitions(t, AS_OF, PROTECTED_IDS)
    assert late.count() > before
    assert spark_rows(late.filter(late.due_at < clock.instant(AS_OF))) == spark_rows(expected)


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata"])
def test_trial_timers_in_any_zone(spark, sf_dir, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = spark_rows(STREAMS["stream_trial_timers"](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    t = derived_tables(spark, sf_dir)
    assert got == spark_rows(trials.timed_transitions(t, AS_OF, PROTECTED_IDS))


def test_no_events_leave_the_tables_as_they_are(spark, t):
    run = WebhookStream(spark, t, AS_OF, shared_dir(spark, "test"))
    assert run.subscriptions().count() == t.stripe_subscriptions.count()
    assert run.new_orders().count() == 0


# Timers by due hour -------------------------------------------------------------


class Timers:
    """Trial rows and ticks given step by step."""

    def __init__(self, spark, tmp_path, **tables):
        from hand import tables as hand_tables

        self.spark, self.files = spark, str(tmp_path)
        self.t = hand_tables(spark, **tables)
        self.root = shared_dir(spark, "timers")

    def step(self, at, *rows, t=None):
        from hand import frame

        given = frame(self.spark, "user_trials", rows).coalesce(1)
        given.write.mode("append").parquet(f"{self.files}/trials")
        tick = self.spark.createDataFrame([(at,)], struct(at="ts"))
        tick.coalesce(1).write.mode("append").parquet(f"{self.files}/ticks")
        self.run = TrialTimers(self.spark, t or self.t, [], self.root, merge_every=2)
        self.run.run(
            read_stream(self.spark, f"{self.files}/trials", SCHEMAS["user_trials"]),
            read_stream(self.spark, f"{self.files}/ticks", struct(at="ts")),
        )
        return sorted((r.user_id, r.trial_status) for r in self.run.due().collect())


def test_a_trial_put_off_is_due_at_its_new_end_alone(spark, tmp_path):
    from hand import AS_OF as NOW
    from hand import DAY, trial

    timers = Timers(spark, tmp_path)
    assert timers.step(NOW, trial(1, end=NOW + DAY), trial(2, end=NOW + DAY)) == []
    extended = trial(1, end=NOW + 5 * DAY, updated_at=NOW)
    converted = trial(3, "converted_to_paid", end=NOW + DAY, updated_at=NOW)
    found = timers.step(NOW + 2 * DAY, extended, trial(3, end=NOW + DAY), converted)
    assert found == [(2, "expired")]
    assert timers.step(NOW + 5 * DAY)[1:] == [(2, "scheduled_for_deletion")]
    found = timers.step(NOW + 5 * DAY + DAY / 2)
    assert [x for x in found if x[0] == 1] == [(1, "expired")]
    # A row that comes long after its end is due at the next tick.
    found = timers.step(NOW + 9 * DAY, trial(4, end=NOW - 90 * DAY))
    assert [s for u, s in found if u == 4] == ["expired", "scheduled_for_deletion"]
    assert not [x for x in found if x[0] == 3]


def test_who_pays_at_the_time_is_due_once_paying_ends(spark, tmp_path):
    from hand import AS_OF as NOW
    from hand import DAY, customer, subscription, tables, trial

    billed = {"stripe_customers": [customer(1)], "stripe_subscriptions": [subscription(1)]}
    timers = Timers(spark, tmp_path, **billed)
    assert timers.step(NOW + DAY, trial(1, end=NOW)) == []
    assert timers.step(NOW + 60 * DAY) == []
    assert timers.step(NOW + 61 * DAY, t=tables(spark, stripe_customers=[customer(1)])) == [
        (1, "expired"),
        (1, "scheduled_for_deletion"),
    ]


def test_a_tick_reads_only_the_hours_since_the_last(spark, tmp_path):
    """Whether the index holds ten days or a hundred, the tick opens as many files."""
    from hand import AS_OF as NOW
    from hand import DAY, trial

    opened = []
    for days in (10, 100):
        timers = Timers(spark, tmp_path / str(days))
        timers.step(NOW, *(trial(i, end=NOW + i * DAY) for i in range(-days // 2, days // 2)))
        opened.append(len(timers.run.index.read(NOW, NOW + 2 * DAY).inputFiles()))
        assert len(timers.run.index.read(None, NOW + 1000 * DAY).inputFiles()) >= days
    assert opened[0] == opened[1] <= 8


def test_a_replayed_tick_changes_nothing(spark, tmp_path):
    from hand import AS_OF as NOW
    from hand import DAY, trial

    timers = Timers(spark, tmp_path)
    timers.step(NOW, trial(1, end=NOW + DAY))
    found = timers.step(NOW + 2 * DAY)
    tick = spark.createDataFrame([(NOW + 2 * DAY,)], struct(at="ts"))
    timers.run._tick(tick, 1)
    assert sorted((r.user_id, r.trial_status) for r in timers.run.due().collect()) == found
    assert found == [(1, "expired")]


# Merged logs ---------------------------------------------------------------------


def test_merged_logs_end_alike(spark, t, shuffled):
    """Merged after every second batch, and read by another object than the writer."""
    root = shared_dir(spark, "test")
    run = WebhookStream(spark, t, AS_OF, root, merge_every=2)
    run.run(stream(spark, shuffled, "webhook_events"))
    batch = billing.subscription_upsert(t, t.webhook_events, AS_OF)
    other = WebhookStream(spark, t, AS_OF, root, merge_every=2)
    expected = spark_rows(batch.select(*SUBSCRIPTION_VIEW))
    assert spark_rows(other.subscriptions().select(*SUBSCRIPTION_VIEW)) == expected
    orders = billing.order_inserts(t.webhook_events)
    assert spark_rows(other.new_orders().select(*orders.columns)) == spark_rows(orders)
    effects = billing.subscription_change_effects(
        t, billing.subscription_changes(t.webhook_events), AS_OF
    )
    assert spark_rows(other.trials()) == spark_rows(effects)
    # A replay of merged batches, with whatever rows, changes nothing.
    for batch_id in (0, 1):
        other._take(t.webhook_events.limit(3), batch_id)
    assert spark_rows(other.subscriptions().select(*SUBSCRIPTION_VIEW)) == expected
    signups = SignupStream(spark, t, shared_dir(spark, "test"), merge_every=2)
    signups.run(stream(spark, shuffled, "signups"))
    assert spark_rows(signups.provisioned()) == spark_rows(accounts.signup_provisioning(t, t.signups))


def test_a_log_lists_only_what_came_since_the_merge(spark):
    schema = struct(user_id="long", n="long")
    log = ChangeLog(
        spark,
        shared_dir(spark, "log"),
        schema,
        lambda df: extreme_per_key(df, ["user_id"], ["n", "batch_id"]),
        merge_every=5,
    )
    for i in range(23):
        rows = spark.createDataFrame([(u, i * 10 + u) for u in range(3)], schema)
        log.write(rows.coalesce(1), i)
        again = ChangeLog(spark, log.root, schema)
        folders = {f.rsplit("/", 2)[1] for f in again.read().inputFiles()}
        assert len(folders) <= 5 + 1
    found = extreme_per_key(log.read(), ["user_id"], ["n", "batch_id"])
    assert sorted((r.user_id, r.n, r.batch_id) for r in found.collect()) == [
        (u, 220 + u, 22) for u in range(3)
    ]


def test_a_merge_that_fails_has_changed_nothing(spark, monkeypatch):
    schema = struct(user_id="long")
    log = ChangeLog(spark, shared_dir(spark, "log"), schema, lambda df: df, merge_every=3)
    one = lambda i: spark.createDataFrame([(i,)], schema)
    log.write(one(0), 0)
    log.write(one(1), 1)

    def fail(self, **values):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(Record, "write", fail)
        with pytest.raises(OSError):
            log.write(one(2), 2)
    again = ChangeLog(spark, log.root, schema, lambda df: df, merge_every=3)
    assert sorted(r.user_id for r in again.read().collect()) == [0, 1, 2]
    again.write(one(2), 2)
    again.write(one(3), 3)
    assert sorted(r.user_id for r in again.read().collect()) == [0, 1, 2, 3]
    assert again._state()[1] == 2


# Continuous refresh ---------------------------------------------------------------


def test_two_ticks_change_access_without_an_event(spark, tmp_path):
    """One query, never restarted: users wake at their own trial's end, put off or not."""
    from hand import AS_OF as NOW
    from hand import DAY, by, customer, frame, tables, trial

    t = tables(
        spark,
        user_trials=[trial(i, end=NOW + i * DAY) for i in (1, 2, 3, 4)],
        stripe_customers=[customer(2), customer(4)],
    )
    files = str(tmp_path)
    paid = {
        "event_id": "evt_1",
        "type": "customer.subscription.updated",
        "created": NOW,
        "customer": "cus_2",
        "subscription_id": "sub_2",
        "subscription_status": "active",
    }
    schemas = {
        "ticks": struct(at="ts"),
        "user_trials": SCHEMAS["user_trials"],
        "webhook_events": SCHEMAS["webhook_events"],
    }

    def give(name, *rows):
        given = frame(spark, name, rows, schemas[name])
        given.coalesce(1).write.mode("append").parquet(f"{files}/{name}")

    for name in schemas:
        give(name)
    streams = {n: read_stream(spark, f"{files}/{n}", s) for n, s in schemas.items()}
    feed = AccessFeed(spark, t, NOW, shared_dir(spark, "live"), merge_every=2)
    query = feed.start(
        streams["ticks"], streams["webhook_events"], streams["user_trials"], every="0 seconds"
    )

    def access_by():
        query.processAllAvailable()
        return {u: r.has_access for u, r in by(feed.latest()).items()}

    try:
        run = query.runId
        give("webhook_events", paid)
        give("user_trials", trial(3, end=NOW + 9 * DAY, updated_at=NOW))
        assert access_by() == {2: True, 3: True}
        give("ticks", {"at": NOW + DAY})
        assert access_by() == {1: False, 2: True, 3: True}
        # At 2 the payer stays, at 3 the trial was put off, at 4 a free trial ends.
        give("ticks", {"at": NOW + 4.5 * DAY})
        assert access_by() == {1: False, 2: True, 3: True, 4: False}
        give("ticks", {"at": NOW + 2 * DAY})  # a clock that goes back is not followed
        give("ticks", {"at": NOW + 9 * DAY})
        assert access_by() == {1: False, 2: True, 3: False, 4: False}
        assert query.runId == run and query.isActive
    finally:
        query.stop()
    # Started again, the feed goes on at the time it had reached.
    again = AccessFeed(spark, t, NOW, feed.root, merge_every=2)
    query = again.start(
        streams["ticks"], streams["webhook_events"], streams["user_trials"], every="0 seconds"
    )
    try:
        give("user_trials", trial(1, end=NOW + 8 * DAY, updated_at=NOW + DAY))
        query.processAllAvailable()
        assert not by(again.latest())[1].has_access
    finally:
        query.stop()


def test_a_batch_opens_only_its_users_buckets(spark, t, tmp_path):
    """A trial changes: of each base table one bucket of 16 is read, with the same result."""
    stored = StoredTables.store(t, shared_dir(spark, "base"), 16)
    row = t.user_trials.orderBy("user_id").limit(1).collect()
    given = spark.createDataFrame(row, t.user_trials.schema)
    near = stored.of_users(t, given.select("user_id"))
    for name in ("stripe_customers", "user_trials", "stripe_subscriptions"):
        files = {f.split("/bucket=")[1].split("/")[0] for f in getattr(near, name).inputFiles()}
        assert len(files) <= 1, name
    given.coalesce(1).write.parquet(str(tmp_path / "trials"))
    found = []
    for base in (None, stored):
        feed = AccessFeed(spark, t, AS_OF, shared_dir(spark, "feed"), stored=base)
        feed.run(trials=read_stream(spark, str(tmp_path / "trials"), t.user_trials.schema))
        found.append(spark_rows(feed.latest()))
    assert found[0] == found[1] and sum(found[0][1].values()) == 1
