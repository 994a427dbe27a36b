"""Parquet and JSON-lines tables with declared schemas; no inference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.model import SCHEMAS, Tables, struct, with_user_ids
from tenure.operators.keyed import conform
from tenure.sources.manifest import Record, new_path, rows_if_any


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_tables(
    spark: SparkSession, root: str, fmt: str = "parquet", user_ids: str = "string"
) -> Tables:
    """The tables below ``root``, one folder each, read when first used.

    ``user_ids`` is the type of the user ids: text (uuids) or ``long``.
    """
    kind = T.LongType() if user_ids == "long" else T.StringType()

    def load(name: str) -> DataFrame:
        schema = with_user_ids(SCHEMAS[name], kind, name)
        return read_table(spark, f"{root}/{name}", schema, fmt)

    return Tables(load)


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    glob: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def append_rows(df: DataFrame, path: str, schema: T.StructType, fmt: str = "parquet") -> None:
    """The append sink: add rows in the declared shape."""
    conform(df, schema).write.mode("append").format(fmt).save(path)


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a new snapshot to a path of its own; never over one being read."""
    df.write.mode("errorifexists").format(fmt).save(path)


# The key on which each table meets most others.
BUCKET_KEYS = {
    "users": "user_id",
    "stripe_customers": "customer_id",
    "stripe_subscriptions": "customer_id",
    "stripe_orders": "customer_id",
    "user_trials": "user_id",
    "user_profiles": "id",
    "linked_accounts": "user_id",
    "user_account_state": "user_id",
    "deleted_account_history": "email",
}


def save_bucketed(t: Tables, root: str, prefix: str, buckets: int, names=tuple(BUCKET_KEYS)):
    """Store tables pre-partitioned and sorted by key, as ``<prefix><name>``.

    Written once per snapshot, this spares every later job the shuffle of
    these tables on that key.
    """
    for name in names:
        key = BUCKET_KEYS[name]
        df = getattr(t, name)
        (
            df.repartition(buckets, key)
            .write.mode("errorifexists")
            .option("path", f"{root}/{name}")
            .bucketBy(buckets, key)
            .sortBy(key)
            .saveAsTable(f"{prefix}{name}")
        )


def bucketed_tables(spark: SparkSession, prefix: str, names=tuple(BUCKET_KEYS)) -> Tables:
    return Tables(lambda name: spark.table(f"{prefix}{name}"), names)


#: A log merges its batches once so many have come since the last merge.
MERGE_EVERY = 64
_MERGES = struct(epoch="long", upto="long", path="string")


class ChangeLog:
    """What the batches of a stream have written, one folder per batch.

    A batch replayed after a failure replaces its own folder, so each batch
    counts once, and a batch's work does not grow with the snapshot. Readers
    reduce the log by key; all reductions used here give the same result
    whatever the order and grouping of the batches.

    With ``reduce``, every ``merge_every`` batches the log is reduced into one merged
    folder. Batches then start an epoch, a folder of folders, of their own, so reading lists
    the batches since the last merge and no others. A record of two alternating folders names
    the merged folder and the last batch in it: a merge that fails before the record is
    written has changed nothing, and a batch that is replayed after it is already contained
    and not written again. Merged-over folders are not read any more and may be deleted.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: T.StructType,
        reduce: Callable[[DataFrame], DataFrame] | None = None,
        merge_every: int = MERGE_EVERY,
    ):
        self.spark, self.root, self.schema = spark, root, schema
        self._reduce, self._merge_every = reduce, merge_every
        self._whole = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
        self._record = Record(spark, f"{root}/merges", _MERGES)
        self._merged: Row | None = None

    def _state(self) -> tuple[int, int, str | None]:
        """The epoch, the last merged batch and the merged folder. A log has one writer, so
        what this one has merged is the newest; others look into the record."""
        if self._merged is None:
            self._merged = self._record.read()
        if self._merged is None:
            return 0, -1, None
        return self._merged["epoch"], self._merged["upto"], self._merged["path"]

    def _batch(self, epoch: int, batch_id: int) -> str:
        return f"{self.root}/epoch={epoch}/batch_id={batch_id}"

    def write(self, df: DataFrame, batch_id: int) -> None:
        epoch, upto, _ = self._state()
        if batch_id <= upto:
            return
        conform(df, self.schema).write.mode("overwrite").parquet(self._batch(epoch, batch_id))
        if self._reduce is not None and batch_id - upto >= self._merge_every:
            self.merge(batch_id)

    def merge(self, upto: int) -> None:
        """Reduce all rows, up to the given batch, to one folder; no later batch may exist."""
        epoch, _, _ = self._state()
        path = new_path(self.root, f"merged-{epoch + 1}")
        reduced = self._reduce(self.read())
        if "batch_id" not in reduced.columns:
            reduced = reduced.withColumn("batch_id", F.lit(upto))
        conform(reduced, self._whole).write.mode("errorifexists").parquet(path)
        self._record.write(epoch=epoch + 1, upto=upto, path=path)
        self._merged = self._record.read()

    def read_batch(self, batch_id: int) -> DataFrame:
        """The rows of one batch since the last merge, from its own folder alone."""
        epoch, upto, _ = self._state()
        if batch_id <= upto:
            raise ValueError(f"batch {batch_id} has been merged")
        return self.spark.read.schema(self.schema).parquet(self._batch(epoch, batch_id))

    def read(self) -> DataFrame:
        """All rows so far, with the ``batch_id`` that wrote them."""
        epoch, _, merged = self._state()
        recent = rows_if_any(
            lambda: self.spark.read.schema(self._whole).parquet(f"{self.root}/epoch={epoch}")
        )
        if recent is None:  # no batch has come yet, or none since the merge
            recent = self.spark.createDataFrame([], self._whole)
        if merged is None:
            return recent
        return self.spark.read.schema(self._whole).parquet(merged).unionByName(recent)
