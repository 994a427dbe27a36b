"""Bucketed snapshots: a change reads and writes the buckets it touches and no others."""

import pytest
from compare import spark_rows

from tenure.model import struct
from tenure.operators.keyed import change_feed, insert_if_absent
from tenure.plans import accounts
from tenure.session import shared_dir
from tenure.sources.derived import AS_OF, derived_tables
from tenure.sources.snapshots import BucketedSnapshot


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return derived_tables(spark, sf_dir)


def stored(spark, t, count=32):
    profiles = BucketedSnapshot(
        spark, shared_dir(spark, "snapshot"), t.user_profiles.schema, "id", count
    )
    profiles.create(t.user_profiles)
    return profiles


def test_a_small_batch_touches_its_buckets_alone(spark, t):
    profiles = stored(spark, t)
    before = profiles.state()
    assert spark_rows(profiles.read()) == spark_rows(t.user_profiles)
    two = t.profile_batch.orderBy("user_id").limit(2).collect()
    batch = spark.createDataFrame([*two, two[0]], t.profile_batch.schema)
    read = []

    def change(old):
        read.extend(old.inputFiles())
        return accounts.profile_upsert(t.replace(user_profiles=old), batch, AS_OF)

    after = profiles.rewrite(batch.select("user_id"), change)
    touched = profiles.buckets_of(batch.select("user_id"))
    assert 0 < len(touched) <= 2
    assert {f.split("/bucket=")[1].split("/")[0] for f in read} <= set(map(str, touched))
    for i, bucket in after.buckets.items():
        assert (before.buckets.get(i) == bucket) == (i not in touched)
    whole = accounts.profile_upsert(t, batch, AS_OF)
    assert spark_rows(profiles.read()) == spark_rows(whole)
    # The feed opens the buckets that differ; the earlier state is still there.
    feed = profiles.changes(before)
    files = {f.split("/bucket=")[1].split("/")[0] for f in feed.inputFiles()}
    assert files <= set(map(str, touched))
    assert spark_rows(feed) == spark_rows(change_feed(t.user_profiles, whole, "id"))
    assert spark_rows(profiles.read(before)) == spark_rows(t.user_profiles)


def test_a_rewrite_without_effect_opens_nothing_for_the_feed(spark, t):
    profiles = stored(spark, t, 4)
    before = profiles.state()
    after = profiles.rewrite(t.user_profiles.select("id"), lambda old: old.repartition(7))
    assert before.version < after.version and before.differing(after) == set()
    assert profiles.changes(before).inputFiles() == []


def test_a_batch_given_twice_inserts_once(spark):
    schema = struct(checkout_session_id="string", amount="long")
    orders = BucketedSnapshot(spark, shared_dir(spark, "orders"), schema, "checkout_session_id", 8)
    rows = spark.createDataFrame([(f"cs_{i}", i) for i in range(50)], schema)
    for batch in (rows, rows, rows.limit(10)):
        keys = batch.select("checkout_session_id")
        orders.rewrite(keys, lambda old, b=batch: insert_if_absent(old, b, "checkout_session_id"))
    assert spark_rows(orders.read()) == spark_rows(rows)


def test_buckets_may_become_empty_and_odd_changes_are_refused(spark):
    schema = struct(id="long", n="long")
    table = BucketedSnapshot(spark, shared_dir(spark, "odd"), schema, "id", 8)
    assert table.read().count() == 0 and table.state().version == 0
    rows = spark.createDataFrame([(i, i) for i in range(40)] + [(None, 1)], schema)
    table.create(rows)
    assert spark_rows(table.read()) == spark_rows(rows)
    state = table.state()
    assert table.rewrite(rows.limit(0).select("id"), lambda old: old) == state
    one = rows.filter("id = 3")
    with pytest.raises(ValueError):
        table.rewrite(one.select("id"), lambda old: rows)
    assert table.state() == state and spark_rows(table.read()) == spark_rows(rows)
    table.rewrite(rows.select("id"), lambda old: old.filter("id = 3"))
    assert spark_rows(table.read()) == spark_rows(one) and len(table.state().buckets) == 1
    table.rewrite(one.select("id"), lambda old: old.limit(0))
    assert table.read().count() == 0
