from pyspark.sql import functions as F

from hand import by, customer, frame, history, profile, state, subscription, tables, trial

from tenure.functions.text import as_json_rows, first_filled, label, spaced_once
from tenure.model import SCHEMAS, struct
from tenure.operators import quality
from tenure.operators.keyed import change_feed, extreme_per_key, insert_if_absent
from tenure.sources.tables import append_rows, read_table, read_tables, write_snapshot

PAIR = struct(k="long", v="string", n="long")


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), PAIR)


def test_extreme_per_key_on_a_hot_key(spark):
    rows = [(1 if i % 3 == 0 else i % 40, f"v{i}", i) for i in range(3000)]
    got = {r.k: r.v for r in extreme_per_key(pairs(spark, *rows), ["k"], ["n"]).collect()}
    last = {k: v for k, v, _ in rows}
    assert got == last
    first = extreme_per_key(pairs(spark, *rows), ["k"], ["n"], newest=False)
    assert {r.k: r.v for r in first.collect()} == {k: v for k, v, _ in reversed(rows)}


def test_change_feed(spark):
    before = pairs(spark, (1, "a", 1), (2, "b", 2), (3, None, 3))
    after = pairs(spark, (1, "a", 1), (2, None, 5), (4, "d", 4))
    rows = {tuple(r) for r in change_feed(before, after, "k").collect()}
    assert rows == {(2, "UPDATE", "v,n"), (3, "DELETE", ""), (4, "INSERT", "")}


def test_insert_if_absent(spark):
    out = insert_if_absent(pairs(spark, (1, "a", 1)), pairs(spark, (1, "x", 9), (2, "y", 9)), "k")
    assert {tuple(r) for r in out.collect()} == {(1, "a", 1), (2, "y", 9)}


def test_text_functions(spark):
    df = spark.createDataFrame([("a_b_c",), ("",), ("plain",)], "x string")
    rows = df.select(
        spaced_once(F.col("x")), label(F.col("x")), first_filled(F.col("x"), F.lit("none"))
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("a b_c", "A B_C", "a_b_c"),
        ("", "", "none"),
        ("plain", "PLAIN", "plain"),
    ]


def test_json_rows_keep_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a long, b string")
    assert as_json_rows(df).collect()[0].json == '{"a":1,"b":null}'


def test_tables_on_disk(spark, tmp_path):
    t = tables(spark, user_trials=[trial(1)], user_profiles=[profile(1)])
    for fmt in ("parquet", "json"):
        root = f"{tmp_path}/{fmt}"
        for name in ("user_trials", "user_profiles"):
            write_snapshot(getattr(t, name), f"{root}/{name}", fmt)
        stored = read_tables(spark, root, fmt, user_ids="long")
        assert stored.user_trials.schema == SCHEMAS["user_trials"]
        assert stored.user_trials.collect() == t.user_trials.collect()
        append_rows(
            frame(spark, "user_trials", [trial(2)]),
            f"{root}/user_trials",
            SCHEMAS["user_trials"],
            fmt,
        )
        again = read_table(spark, f"{root}/user_trials", SCHEMAS["user_trials"], fmt)
        assert set(by(again)) == {1, 2}


def test_violations_are_found(spark):
    t = tables(
        spark,
        users=[{"user_id": 1}],
        user_profiles=[profile(1), profile(2, email=None)],
        user_trials=[trial(1), trial(1, "odd"), trial(7)] + [trial(8) for _ in range(100)],
        user_account_state=[state(3, access_level="gold")],
        deleted_account_history=[history("a"), history("a"), history(None)],
        stripe_subscriptions=[{"customer_id": "cus_x", "status": None}],
    )
    found = {
        (r.rule, r.table_name): r.violations
        for r in quality.constraint_violations(t).collect()
        if r.violations
    }
    assert found == {
        ("not_null:email", "user_profiles"): 1,
        ("reference:id", "user_profiles"): 1,
        ("values:trial_status", "user_trials"): 1,
        ("unique:user_id", "user_trials"): 2,
        ("reference:user_id", "user_trials"): 101,
        ("values:access_level", "user_account_state"): 1,
        ("reference:user_id", "user_account_state"): 1,
        ("unique:email", "deleted_account_history"): 1,
        ("not_null:email", "deleted_account_history"): 1,
        ("not_null:status", "stripe_subscriptions"): 1,
        ("not_null:id", "stripe_subscriptions"): 1,
        ("unique:id", "user_trials"): 2,
        ("unique:id", "deleted_account_history"): 1,
        ("reference:customer_id", "stripe_subscriptions"): 1,
    }


def test_health(spark):
    empty = quality.health_score(tables(spark)).collect()[0]
    assert not empty.healthy and empty.score == 8 and empty.grade == "poor"
    grades = spark.createDataFrame([(10,), (9,), (8,), (7,), (6,), (5,)], "s int")
    rows = grades.select(quality.grade(F.col("s"), F.lit(10))).collect()
    assert [r[0] for r in rows] == ["excellent", "good", "good", "fair", "fair", "poor"]


def test_health_sees_which_customers_the_views_show(spark):
    def shown(**rows):
        checks = quality.health_checks(tables(spark, **rows)).collect()
        return {r.name for r in checks if r.kind == "view" and r.ok}

    gone, live = subscription(1, deleted=True), subscription(1)
    assert shown(stripe_customers=[customer(1)]) == {"user_subscriptions", "user_orders"}
    assert shown(stripe_customers=[customer(1)], stripe_subscriptions=[gone]) == {"user_orders"}
    both = shown(stripe_customers=[customer(1)], stripe_subscriptions=[gone, live])
    assert both == {"user_subscriptions", "user_orders"}
    assert shown(stripe_customers=[customer(1, deleted=True)], stripe_subscriptions=[live]) == set()
    unnamed = shown(stripe_customers=[customer(1, customer_id=None)], stripe_subscriptions=[gone])
    assert unnamed == {"user_subscriptions", "user_orders"}
