"""Small records on shared storage that say which files of a job or table are whole.

Everything is written and read by Spark, so any store it reaches will do. Data files
are written to paths of their own and become visible by a record that names them; what a
crashed attempt left behind is named by none and never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from tenure.model import struct


def new_path(root: str, name: str) -> str:
    """A path that no other attempt writes to."""
    return f"{root}/{name}-{uuid.uuid4().hex}"


def rows_if_any(reader: Callable[[], DataFrame]) -> DataFrame | None:
    """What the reader finds, or None where nothing has been written yet."""
    try:
        return reader()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class Record:
    """One small row in its newest version, for a single writer.

    Two folders hold it in turn: a new version replaces the older one, so a crash in
    the midst of writing leaves the newest whole, and reading lists two folders however
    many versions there were.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root = spark, root
        self.schema = T.StructType([T.StructField("version", T.LongType()), *schema.fields])

    def _slots(self) -> list[tuple[int, str, Row | None]]:
        out = []
        for slot in ("a", "b"):
            path = f"{self.root}/{slot}"
            found = rows_if_any(lambda path=path: self.spark.read.schema(self.schema).parquet(path))
            row = found.first() if found is not None else None
            out.append((row["version"] if row else 0, path, row))
        return sorted(out, key=lambda s: s[:2])

    def read(self) -> Row | None:
        return self._slots()[-1][2]

    def write(self, **values) -> None:
        older, newest = self._slots()
        row = tuple({"version": newest[0] + 1, **values}[f.name] for f in self.schema)
        frame = self.spark.createDataFrame([row], self.schema).coalesce(1)
        frame.write.mode("overwrite").parquet(older[1])


_ENTRY = struct(name="string", path="string", schema="string")


class Outputs:
    """The named outputs of a job, each written once.

    The manifest gets an entry when an output is whole. A job that starts again
    takes finished outputs as they are and makes the others anew, each in a folder of its own.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def entries(self) -> dict[str, Row]:
        """The finished outputs; of two attempts that both finished, always the same one."""

        def read() -> DataFrame:
            reader = self.spark.read.schema(_ENTRY).option("recursiveFileLookup", "true")
            return reader.parquet(f"{self.root}/manifest")

        found = rows_if_any(read)
        rows = sorted(found.collect(), key=lambda r: r["path"]) if found is not None else []
        return {r["name"]: r for r in reversed(rows)}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The output, written first if it is not there."""
        entry = self.entries().get(name)
        if entry is None:
            path, made = new_path(self.root, name), make()
            made.write.mode("errorifexists").parquet(path)
            one = self.spark.createDataFrame([(name, path, made.schema.json())], _ENTRY)
            one.coalesce(1).write.parquet(new_path(f"{self.root}/manifest", name))
            entry = self.entries()[name]
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        return self.spark.read.schema(schema).parquet(entry["path"])
