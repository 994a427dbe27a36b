"""What the physical plans may and may not contain."""

import re
from collections import Counter

import pytest
from hand import customer, tables
from pyspark.sql import functions as F

from tenure.catalog import BATCH
from tenure.model import SCHEMAS
from tenure.operators.entitlement import rows_of
from tenure.operators.keyed import conform
from tenure.plans import access
from tenure.session import sized_for
from tenure.sources.derived import derived_tables
from tenure.sources.tables import bucketed_tables, save_bucketed


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(spark):
    """Plan as for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


BANNED = (
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BroadcastExchange",
    "Window",
    "collect_list",
    "collect_set",
)


@pytest.mark.parametrize("name", sorted(BATCH))
def test_plan_at_scale(large, sf_dir, name):
    lines = plan(BATCH[name](derived_tables(large, sf_dir))).splitlines()
    assert not [line[:200] for line in lines if any(b in line for b in BANNED)]
    # Rows meet in one partition only as aggregated counts or a probe's limit.
    for line, below in zip(lines, lines[1:]):
        if "Exchange SinglePartition" in line:
            assert re.search(r"HashAggregate\(keys=\[\]|LocalLimit", below), below[:200]


def test_scans_read_only_the_needed_columns(spark, sf_dir):
    text = plan(BATCH["trial_info"](derived_tables(spark, sf_dir)))
    assert re.findall(r"ReadSchema: (\S+)", text) == ["struct<c_custkey:bigint>"]
    text = plan(BATCH["webhook_routes"](derived_tables(spark, sf_dir)))
    (read,) = re.findall(r"ReadSchema: (\S+)", text)
    assert read == "struct<event_id:bigint,user_id:bigint,event_type:string>"


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(BATCH["checkout_validation"](derived_tables(spark, sf_dir)))
    assert "EqualTo(event_type,purchase)" in text


def test_one_shuffle_for_the_newest_subscription(large, sf_dir):
    """The grouping and the join on the customer share one shuffle."""
    text = plan(BATCH["paying_users"](derived_tables(large, sf_dir)))
    assert text.count("Exchange hashpartitioning(customer_id") == 2  # one per side
    assert "partial_max" in text


def test_a_point_read_reaches_the_scan(spark, sf_dir):
    t = derived_tables(spark, sf_dir)
    text = plan(rows_of(BATCH["access_status"](t), 7))
    assert len(re.findall(r"EqualTo\(c_custkey,7\)", text)) == 2


def test_a_hot_customer_is_split_between_tasks(large):
    """One customer holds a third of all orders: the join splits its partition."""
    thresholds = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: large.conf.get(k, None) for k in thresholds}
    for key, value in thresholds.items():
        large.conf.set(key, value)
    try:
        owner = F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 999)
        orders = large.range(300_000, numPartitions=12).select(
            "id", F.concat(F.lit("cus_"), owner.cast("string")).alias("customer_id")
        )
        t = tables(large, stripe_customers=[customer(i) for i in range(1_000)])
        t = t.replace(stripe_orders=conform(orders, SCHEMAS["stripe_orders"]))
        df = access.user_orders(t)
        rows = df.collect()
        text = plan(df)
    finally:
        for key, value in before.items():
            large.conf.unset(key) if value is None else large.conf.set(key, value)
    assert "skew=true" in text
    expected = Counter(1 if i % 3 == 0 else i % 999 for i in range(300_000))
    expected += Counter({i: 1 for i in range(1_000) if i not in expected})  # empty rows
    assert Counter(int(r.customer_id[4:]) for r in rows) == expected


def test_settings_grow_with_the_input():
    assert sized_for(0)["spark.sql.shuffle.partitions"] == "8"
    assert sized_for(100 * 2**40)["spark.sql.shuffle.partitions"] == "102400"


def test_bucketed_tables_are_not_shuffled_again(large, sf_dir, tmp_path):
    t = derived_tables(large, sf_dir)
    names = (
        "stripe_customers",
        "stripe_subscriptions",
        "user_trials",
        "user_profiles",
        "linked_accounts",
        "user_account_state",
    )
    save_bucketed(t, str(tmp_path), "kept_", 4, names)
    stored = bucketed_tables(large, "kept_", names)
    try:
        df = access.user_overview(stored)
        text = plan(df)
        # Only the billing rows move, from the customer key to the user key.
        assert text.count("Exchange hashpartitioning") == 1
        view = access.user_overview(t)
        assert sorted(map(str, df.collect())) == sorted(map(str, view.collect()))
    finally:
        for name in names:
            large.sql(f"DROP TABLE kept_{name}")
