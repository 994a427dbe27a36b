"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Adaptive execution sizes the shuffles, picks joins from measured sizes and
# splits partitions that a hot key has made too large.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


SHUFFLE_INPUT_BYTES = 1 << 30
SCAN_BYTES = 512 << 20
MERGED_BYTES = 128 << 20


def sized_for(input_bytes: int) -> dict[str, str]:
    """Shuffle and scan settings for an input of the given size.

    The jobs shuffle a few narrow columns of what they read, so a reducer per GB
    of input gets well below that. The number of map and reduce tasks is what the
    driver's bookkeeping grows with: 100 TB make some 200,000 map tasks and
    100,000 reducers. Adaptive execution merges reducers that turn out small.
    """
    count = max(8, -(-input_bytes // SHUFFLE_INPUT_BYTES))
    scan = SCAN_BYTES if input_bytes >= 1 << 40 else MERGED_BYTES
    return {
        "spark.sql.shuffle.partitions": str(count),
        "spark.sql.files.maxPartitionBytes": str(scan),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(MERGED_BYTES),
    }


def build_session(
    app: str = "tenure", input_bytes: int | None = None, **extra: str
) -> SparkSession:
    """A session with the library's settings, sized for the input where its size is known."""
    sized = sized_for(input_bytes) if input_bytes is not None else {}
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **sized, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one the cluster names in ``spark.checkpoint.dir``.

    Snapshots and streaming checkpoints go there, so that they outlive any
    executor. Only a local-mode session may go without the setting; it then
    gets a temporary folder of its own.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tenure-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
