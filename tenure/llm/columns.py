"""Column expressions and task helpers that several operators share."""

from __future__ import annotations

import os
import string
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tenure.session import CHECKPOINT_KEY, shared_dir

# Fixed: the white space that separates words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key(text: Column) -> Column:
    """The same for equal texts, null and empty alike; with an id it names a row whose id is no key."""
    return F.md5(F.coalesce(text, F.lit("")))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def uniform(*keys: str | Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the key columns and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def saved(frame: DataFrame) -> DataFrame:
    """The frame, computed now into the folder that all executors share.

    What follows neither repeats the work nor depends on the executors that
    did it.
    """
    spark = frame.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        root = spark.conf.get(CHECKPOINT_KEY, None) or os.path.dirname(shared_dir(spark, "saved"))
        spark.sparkContext.setCheckpointDir(root)
    return frame.checkpoint(eager=True)


#: A table of up to so many narrow rows is sent to every executor (some 10 MB).
BROADCAST_ROWS = 100_000
_SALTS = 32


def attach(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with one saved row per key, also where a key is hot.

    Up to BROADCAST_ROWS keys are broadcast. Beyond that each key is repeated per
    salt, so that a hot key's rows spread over as many tasks.
    """
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key)
    salted = small.withColumn("_salt", F.explode(F.array(*(F.lit(i) for i in range(_SALTS)))))
    # From the row itself, so that a task that is run again deals the same salts.
    plain = [f.name for f in rows.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(_SALTS)).cast("int"))
    return spread.join(salted, [key, "_salt"]).drop("_salt")


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The strings of a column, null as the empty one."""
    return [t or "" for t in batch.column(name).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as none."""
    return [t or b"" for t in batch.column(name).cast(pa.large_binary()).to_pylist()]


def arrow_batch(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
    )
