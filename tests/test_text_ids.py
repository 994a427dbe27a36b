"""Text user ids give the same results as numbers."""

import pytest
from compare import spark_rows
from pyspark.sql import functions as F

from tenure.catalog import BATCH
from tenure.sources.derived import derived_tables
from tenure.sources.tables import read_tables, write_snapshot

ID_COLUMNS = {"user_id", "original_user_id", "viewer_id"}


def as_text(df, more=()):
    named = ID_COLUMNS | set(more)
    return df.select(*[F.col(c).cast("string") if c in named else F.col(c) for c in df.columns])


@pytest.fixture(scope="module")
def numbered(spark, sf_dir):
    return derived_tables(spark, sf_dir)


@pytest.fixture(scope="module")
def texts(numbered):
    def load(name):
        more = ("id",) if name in ("user_profiles", "profile_batch") else ()
        return as_text(getattr(numbered, name), more)

    return type(numbered)(load, numbered.names)


@pytest.mark.parametrize(
    "name",
    [
        "access_status",
        "admin_overview",
        "entitled_rows",
        "sync_trials",
        "deletion_run",
        "purge_users",
        "deletion_history_record",
        "profile_upsert",
        "account_state_sync",
        "signup_provisioning",
        "restore_on_subscription",
        "checkout_inserts",
        "constraint_violations",
    ],
)
def test_same_result(numbered, texts, name):
    more = ("id",) if name == "profile_upsert" else ()
    got, expected = BATCH[name](texts), as_text(BATCH[name](numbered), more)
    assert spark_rows(got) == spark_rows(expected)


def test_read_by_default(spark, texts, tmp_path):
    for name in ("user_trials", "user_profiles", "deleted_account_history"):
        write_snapshot(getattr(texts, name), f"{tmp_path}/{name}")
    stored = read_tables(spark, str(tmp_path))
    assert stored.user_profiles.schema["id"].dataType.simpleString() == "string"
    for name in ("user_trials", "user_profiles", "deleted_account_history"):
        assert spark_rows(getattr(stored, name)) == spark_rows(getattr(texts, name))
