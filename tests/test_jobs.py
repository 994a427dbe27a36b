"""The cleanup job: one written list, and the same end state wherever it was stopped."""

from collections import Counter

import pytest
from compare import spark_rows
from pyspark.sql import functions as F
from test_plans import large, plan  # noqa: F401

from tenure.jobs.cleanup import CleanupJob
from tenure.plans import access, accounts, billing, trials
from tenure.session import shared_dir
from tenure.sources import manifest
from tenure.sources.derived import AS_OF, PROTECTED_IDS, derived_tables


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return derived_tables(spark, sf_dir)


@pytest.fixture(scope="module")
def later(t):
    """The tables when the deletion starts: by then every other subscription pays."""
    after = billing.subscription_upsert(t, t.webhook_events, AS_OF)
    pays = F.when(F.crc32(F.col("customer_id").cast("binary")) % 2 == 0, "active")
    return t.replace(stripe_subscriptions=after.withColumn("status", F.coalesce(pays, "status")))


def job(spark, t, later, root):
    return CleanupJob(spark, t, AS_OF, PROTECTED_IDS, root, recheck=later)


def state(job, after):
    tables = {n: spark_rows(getattr(after, n)) for n in trials.PURGED_TABLES}
    return {
        **tables,
        "history": spark_rows(after.deleted_account_history),
        "report": spark_rows(job.report()),
        "results": spark_rows(job.results()),
    }


@pytest.fixture(scope="module")
def whole(spark, t, later):
    run = job(spark, t, later, shared_dir(spark, "cleanup"))
    return state(run, run.run())


def test_the_list_is_that_of_the_run(spark, t, later):
    run = trials.deletion_run(t, AS_OF, PROTECTED_IDS, recheck=later)
    listed = trials.deletion_list(t, AS_OF, PROTECTED_IDS, recheck=later)
    assert spark_rows(listed.select(*run.columns)) == spark_rows(run)
    assert {r.decision for r in run.collect()} == {"delete", "protected"}


def test_the_end_state_is_that_of_the_single_steps(spark, t, later, whole):
    gone = trials.to_delete(trials.deletion_run(t, AS_OF, PROTECTED_IDS, recheck=later))
    history = accounts.deletion_history_record(t, gone, AS_OF)
    purged = trials.purge_users(t, gone)
    assert whole["history"] == spark_rows(history)
    for name in trials.PURGED_TABLES:
        assert whole[name] == spark_rows(getattr(purged, name)), name


@pytest.mark.parametrize("stop", (0, 1, 4, 9))
def test_a_restart_after_any_output_ends_alike(spark, t, later, whole, monkeypatch, stop):
    """Stopped after so many outputs, once before the manifest names the next one, the job goes
    on with changed tables and neither judges again nor writes an output twice."""
    root, made = shared_dir(spark, "cleanup"), []
    once = manifest.Outputs.once

    class Stopped(Exception):
        pass

    def counted(self, name, make):
        def making():
            if len(made) == stop:
                made.append(None)
                # Left behind: a whole folder that no manifest names.
                make().write.parquet(manifest.new_path(self.root, name))
                raise Stopped
            made.append(name)
            return make()

        return once(self, name, making)

    monkeypatch.setattr(manifest.Outputs, "once", counted)
    try:
        job(spark, t, later, root).run()
    except Stopped:
        pass
    # By now nobody pays any more; the list, once written, stands.
    changed = later if stop == 0 else t.replace(stripe_subscriptions=t.stripe_subscriptions.limit(0))
    again = job(spark, t, changed, root)
    assert state(again, again.run()) == whole
    assert max(Counter(n for n in made if n).values()) == 1


def test_the_list_joins_the_payers_once(large, sf_dir):  # noqa: F811
    t = derived_tables(large, sf_dir)
    listed = trials.deletion_list(t, AS_OF, PROTECTED_IDS)
    text = plan(listed)
    assert text.count("SortMergeJoin") == 3  # customers with subscriptions, trials, users
    run = CleanupJob(large, t, AS_OF, PROTECTED_IDS, shared_dir(large, "cleanup"))
    for frame in (trials.purge_report(t, run.doomed()), run.next_history()):
        moved = [x for x in plan(frame).splitlines() if "Exchange " in x and "Reused" not in x]
        # One more makes the derived subscription table itself.
        assert len(moved) <= 5 + 1, moved


def test_purge_keeps_rows_without_an_owner(spark):
    from hand import customer, frame, subscription, tables, trial, user

    t = tables(
        spark,
        users=[user(1), user(2)],
        stripe_customers=[customer(1), customer(2, deleted=True)],
        stripe_subscriptions=[subscription(1), subscription(2), subscription(3, customer_id=None)],
        user_trials=[trial(1), trial(2)],
    )
    gone = frame(spark, "users", [user(2), user(2), user(9)])
    counts = {r.table_name: (r.removed, r.remaining) for r in trials.purge_report(t, gone).collect()}
    assert counts["users"] == counts["stripe_customers"] == counts["user_trials"] == (1, 1)
    assert counts["stripe_subscriptions"] == (1, 2) and counts["stripe_orders"] == (0, 0)
    after = trials.without_owners(t, "stripe_subscriptions", trials.owner_keys(t, gone))
    assert sorted(r.id for r in after.collect()) == [1, 3]
    assert access.paying_users(t.replace(stripe_subscriptions=after)).count() == 1


def test_a_record_survives_a_write_that_fails(spark):
    root = shared_dir(spark, "record")
    schema = manifest.struct(name="string")
    record = manifest.Record(spark, root, schema)
    assert record.read() is None
    for i in range(5):
        record.write(name=f"v{i}")
        assert manifest.Record(spark, root, schema).read()["name"] == f"v{i}"
    # The next version goes to the older folder; cut short, it leaves no rows there.
    older = record._slots()[0][1]
    spark.createDataFrame([], record.schema).write.mode("overwrite").parquet(older)
    assert record.read()["name"] == "v4"
    record.write(name="v5")
    assert record.read()["name"] == "v5"
