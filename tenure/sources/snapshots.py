"""A table as buckets of its key, of which a change rewrites only those it touches.

Every bucket has a folder, and a manifest names the folder of each and a digest of its
rows. A change reads the buckets of the given keys, writes their next rows to new folders
and then the manifest; all other buckets stay as they are. No folder is ever written over,
so an older state can still be read, and two states are compared by their digests: only
buckets that differ are opened.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.model import Tables, struct
from tenure.operators.keyed import change_feed, conform
from tenure.sources.manifest import Record, new_path

C = F.col

_STATE = struct(state="string")


class Bucket(NamedTuple):
    folder: str
    rows: int
    #: Sum and exclusive or of the rows' hashes, whatever their order.
    digest: str


class State(NamedTuple):
    """The buckets that have rows, in one version of a table."""

    version: int
    buckets: dict[int, Bucket]

    def differing(self, other: "State") -> set[int]:
        told = lambda b: (b.rows, b.digest) if b else None
        every = self.buckets.keys() | other.buckets.keys()
        return {i for i in every if told(self.buckets.get(i)) != told(other.buckets.get(i))}


class BucketedSnapshot:
    """A keyed table of ``count`` buckets below ``root``, for a single writer."""

    def __init__(
        self, spark: SparkSession, root: str, schema: T.StructType, key: str, count: int
    ):
        self.spark, self.root, self.schema = spark, root, schema
        self.key, self.count = key, count
        self._record = Record(spark, f"{root}/manifest", _STATE)

    def state(self) -> State:
        row = self._record.read()
        if row is None:
            return State(0, {})
        told = json.loads(row["state"])
        buckets = {
            int(i): Bucket(told["folders"][folder], rows, digest)
            for i, (folder, rows, digest) in told["buckets"].items()
        }
        return State(row["version"], buckets)

    def _bucket(self, key: str) -> Column:
        # As text, so that equal keys meet whatever integer type they come in.
        return F.pmod(F.xxhash64(C(key).cast("string")), F.lit(self.count)).cast("int")

    def buckets_of(self, keys: DataFrame) -> set[int]:
        """The buckets of the keys in the first column; at most ``count`` numbers."""
        return {r[0] for r in keys.select(self._bucket(keys.columns[0])).distinct().collect()}

    def read(self, state: State | None = None, only: Iterable[int] | None = None) -> DataFrame:
        """The rows of all or some buckets, by now or in an earlier state."""
        buckets = (state or self.state()).buckets
        wanted = buckets.keys() if only is None else buckets.keys() & set(only)
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{buckets[i].folder}/bucket={i}" for i in sorted(wanted)]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def create(self, df: DataFrame) -> State:
        """The first state, or a whole new one."""
        return self._write(df, {}, None)

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> State:
        """Change the rows of the given keys.

        ``change`` gets all rows of the buckets of these keys and returns what comes in
        their place; rows that it adds must have given keys. Any keyed operator will do, as
        none looks beyond the rows of a key.
        """
        before = self.state()
        touched = self.buckets_of(keys)
        if not touched:
            return before
        kept = {i: b for i, b in before.buckets.items() if i not in touched}
        return self._write(change(self.read(before, touched)), kept, touched)

    def _write(self, df: DataFrame, kept: dict[int, Bucket], allowed: set[int] | None) -> State:
        folder = new_path(self.root, "rows")
        rows = conform(df, self.schema).withColumn("bucket", self._bucket(self.key))
        # A large bucket may be split between tasks, and small ones share one.
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
        whole = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        hashed = F.xxhash64(*self.schema.names)
        digest = F.concat_ws(
            "-", F.sum(hashed.cast("decimal(38,0)")).cast("string"), F.bit_xor(hashed).cast("string")
        )
        told = (
            self.spark.read.schema(whole).parquet(folder).groupBy("bucket")
            .agg(F.count(F.lit(1)), digest).collect()
        )
        new = {i: Bucket(folder, n, d) for i, n, d in told}
        if allowed is not None and not new.keys() <= allowed:
            raise ValueError("a change added rows of keys that were not given")
        buckets = {**kept, **new}
        folders = sorted({b.folder for b in buckets.values()})
        place = {f: i for i, f in enumerate(folders)}
        state = {i: (place[b.folder], b.rows, b.digest) for i, b in sorted(buckets.items())}
        self._record.write(state=json.dumps({"folders": folders, "buckets": state}))
        return self.state()

    def changes(self, before: State, after: State | None = None) -> DataFrame:
        """The change feed between two states; buckets of equal digests are not read."""
        now = after or self.state()
        differing = before.differing(now)
        return change_feed(self.read(before, differing), self.read(now, differing), self.key)


# The key by which each table is stored, so that the rows of some users can be found.
_USER_KEYS = {"stripe_customers": "user_id", "user_trials": "user_id"}
_CUSTOMER_KEYS = {"stripe_subscriptions": "customer_id"}


class StoredTables:
    """Tables as bucketed snapshots, of which the rows of given users can be read alone."""

    def __init__(self, snapshots: dict[str, BucketedSnapshot]):
        self.snapshots = snapshots

    @classmethod
    def store(cls, t: Tables, root: str, buckets: int) -> "StoredTables":
        found = {}
        for name, key in {**_USER_KEYS, **_CUSTOMER_KEYS}.items():
            table = getattr(t, name)
            found[name] = BucketedSnapshot(
                table.sparkSession, f"{root}/{name}", table.schema, key, buckets
            )
            found[name].create(table)
        return cls(found)

    def of_users(self, t: Tables, users: DataFrame) -> Tables:
        """``t`` with, in place of the stored tables, the buckets that hold rows of these
        users and of their customers. Rows of other users are still among them."""
        near: dict[str, DataFrame] = {}
        buckets = None
        for name in _USER_KEYS:
            snapshot = self.snapshots[name]
            if buckets is None:
                buckets = snapshot.buckets_of(users.select("user_id"))
            near[name] = snapshot.read(only=buckets)
        customers = near["stripe_customers"].join(users.select("user_id"), "user_id", "left_semi")
        for name in _CUSTOMER_KEYS:
            snapshot = self.snapshots[name]
            near[name] = snapshot.read(only=snapshot.buckets_of(customers.select("customer_id")))
        return t.replace(**near)
