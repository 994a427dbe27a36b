"""Rows filed by the hour in which they fall due.

A row is filed under each hour in which it, or an older row of its key, falls due. So
whoever reads an hour finds the newest row of every key that was ever filed there,
and a row that was put off is seen as such at its old hour without a look at any
other file. A day is a folder and its rows are sorted by hour: reading a span of time lists and
opens the files of its days only, and of those the parts that hold its hours.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.operators.keyed import conform, extreme_per_key
from tenure.sources.manifest import rows_if_any

C = F.col

#: A longer span is listed as a whole.
MOST_DAYS = 400


def hour_of(at: Column) -> Column:
    """The hour's name, by which hours also sort; the session's time zone has no part in it."""
    return F.translate(F.substring(at.cast("string"), 1, 13), " ", "-")


class DueIndex:
    """Rows of ``schema`` by due hour.

    Of a key's rows the newest by the first column of ``order`` counts; of those the one that a
    later batch filed, and then the one that is last by the other columns.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: T.StructType,
        key: str,
        order: Sequence[str] = (),
    ):
        self.spark, self.root, self.schema = spark, root, schema
        self.key, self.order = key, list(order)

    def file(self, rows: DataFrame, hours: Column, batch_id: int) -> None:
        """File each row under all of its hours; a replayed batch replaces its own files.

        A day's rows come together first, so that it gets one file per batch, or a few
        where it has very many rows.
        """
        filed = rows.withColumn("hour", F.explode(F.array_distinct(hours))).filter("hour IS NOT NULL")
        filed = conform(
            filed.withColumn("day", F.substring("hour", 1, 10)).withColumn("batch", F.lit(batch_id)),
            self._filed(),
        )
        (
            filed.hint("rebalance", "day")
            .sortWithinPartitions("day", "hour")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day", "batch")
            .parquet(self.root)
        )

    def _filed(self) -> T.StructType:
        text = [T.StructField(c, T.StringType()) for c in ("day", "hour")]
        return T.StructType([*self.schema.fields, *text, T.StructField("batch", T.LongType())])

    def read(self, after: datetime | None, upto: datetime) -> DataFrame:
        """The newest row of each key filed under the hours from ``after`` to ``upto``."""
        first = f"{after:%Y-%m-%d-%H}" if after is not None else ""
        days = "*"
        if after is not None and (upto - after).days < MOST_DAYS:
            count = (upto.date() - after.date()).days + 1
            days = "{" + ",".join(f"{after + timedelta(i):%Y-%m-%d}" for i in range(count)) + "}"
        reader = self.spark.read.schema(self._filed()).option("basePath", self.root)
        found = rows_if_any(lambda: reader.parquet(f"{self.root}/day={days}"))
        if found is None:
            found = self.spark.createDataFrame([], self._filed())
        span = found.filter((C("hour") >= first) & (C("hour") <= f"{upto:%Y-%m-%d-%H}"))
        order = [*self.order[:1], "batch", *self.order[1:]]
        rows = span.select(*self.schema.names, "batch")
        return extreme_per_key(rows, [self.key], order).drop("batch")
