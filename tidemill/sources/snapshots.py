"""Versioned tables: Parquet data files and a log of JSON commits, readable at any version.

Every change is one commit. Data files are written first and belong to no version until a commit names them, so a reader never
sees half a change. A commit is published by giving its file a name that is free; of two writers of one version the second fails.
Appends record only what they add, and every ``WHOLE_EVERY`` versions the full list, so commits stay small however
long the history and a reader replays few of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import EngineError
from tidemill.sources.files import Folder

WHOLE_EVERY = 16
# fixed values: names of column types in a declared schema
TYPES = {"int": T.LongType(), "str": T.StringType(), "float": T.DoubleType(), "bool": T.BooleanType()}


def declared(columns: Iterable[str]) -> T.StructType:
    """The schema of declarations like ``id:int``."""
    fields = []
    for text in columns:
        name, _, kind = text.partition(":")
        if not name or kind not in TYPES:
            raise EngineError(f"snapshot: expected name:type with a type of {', '.join(TYPES)}, got {text!r}")
        fields.append(T.StructField(name, TYPES[kind]))
    return T.StructType(fields)


@dataclass(frozen=True)
class Commit:
    version: int
    operation: str
    timestamp: str
    num_records: int


@dataclass(frozen=True)
class Snapshot:
    """One version of a table."""

    spark: SparkSession
    version: int
    schema: T.StructType
    files: tuple[str, ...]

    def read(self) -> DataFrame:
        """The rows of this version, as a scan of exactly its files."""
        if not self.files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.files)


def _log(version: int) -> str:
    return f"_log/{version:020d}.json"


class SnapshotTable:
    """A versioned table in a folder that all writers and readers share, on any file system Spark can reach."""

    def __init__(self, folder: Folder, spark: SparkSession, schema: T.StructType):
        self.folder, self.spark, self.schema = folder, spark, schema

    @property
    def path(self) -> str:
        return self.folder.path

    # --- opening

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType | Sequence[str]) -> SnapshotTable:
        """A new table; its version 0 has no rows."""
        table = cls(Folder(spark, path), spark, schema if isinstance(schema, T.StructType) else declared(schema))
        if table.folder.text(_log(0)) is not None:
            raise EngineError(f"snapshot: {path} is a table already")
        table._publish({"version": 0, "operation": "CREATE", "schema": table.schema.jsonValue(), "files": [], "num_records": 0})
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SnapshotTable:
        folder = Folder(spark, path)
        first = folder.text(_log(0))
        if first is None:
            raise EngineError(f"snapshot: no table at {path}")
        return cls(folder, spark, T.StructType.fromJson(json.loads(first)["schema"]))

    # --- reading

    def _commit(self, version: int) -> dict[str, Any]:
        text = self.folder.text(_log(version))
        if text is None:
            raise EngineError(f"snapshot: {self.path} has no version {version}")
        return json.loads(text)

    @property
    def version(self) -> int:
        """The latest version."""
        return max(int(n[:-5]) for n in self.folder.names("_log") if n.endswith(".json") and n[0] != ".")

    def snapshot(self, version: int | None = None) -> Snapshot:
        version = self.version if version is None else version
        added: list[list[str]] = []
        at = version
        while True:
            commit = self._commit(at)
            if "files" in commit:
                added.append(commit["files"])
                break
            added.append(commit["added"])
            at -= 1
        files = [f"{self.path}/{f}" for part in reversed(added) for f in part]
        return Snapshot(self.spark, version, self.schema, tuple(files))

    def read(self, version: int | None = None) -> DataFrame:
        return self.snapshot(version).read()

    def history(self) -> list[Commit]:
        """All commits, oldest first."""
        commits = map(self._commit, range(self.version + 1))
        return [Commit(c["version"], c["operation"], c["timestamp"], c["num_records"]) for c in commits]

    def describe(self, version: int | None = None) -> dict[str, Any]:
        version = self.version if version is None else version
        commit = self._commit(version)
        return {k: commit[k] for k in ("version", "operation", "timestamp", "num_records")} | {"num_files": len(self.snapshot(version).files)}

    # --- writing

    def append(self, records: DataFrame | Iterable[Any], once: tuple[str, int] | None = None) -> int:
        """Add rows; returns the new version.

        ``once``: (writer, number) of a numbered batch. If that writer's batch, or a later one, is in the log already, nothing is added.
        """
        before = self.version
        last = self._commit(before)
        if once and last["batches"].get(once[0], -1) >= once[1]:
            return before
        files, n = self._write(records)
        commit = {"version": before + 1, "operation": "APPEND", "num_records": last["num_records"] + n}
        if once:
            commit["batches"] = last["batches"] | {once[0]: once[1]}
        if (before + 1) % WHOLE_EVERY == 0:
            old = [f[len(self.path) + 1 :] for f in self.snapshot(before).files]
            return self._publish(commit | {"files": old + files})
        return self._publish(commit | {"added": files})

    def overwrite(self, records: DataFrame | Iterable[Any]) -> int:
        """Replace all rows; older versions stay readable."""
        before = self.version
        files, n = self._write(records)
        return self._publish({"version": before + 1, "operation": "OVERWRITE", "files": files, "num_records": n})

    def restore(self, version: int) -> int:
        """Publish the rows of an older version as a new one; no data is written."""
        before = self.version
        files = [f[len(self.path) + 1 :] for f in self.snapshot(version).files]
        return self._publish({"version": before + 1, "operation": "RESTORE", "files": files, "num_records": self._commit(version)["num_records"]})

    def _write(self, records: DataFrame | Iterable[Any]) -> tuple[list[str], int]:
        """Write rows to files no version knows yet: (paths within the table, number of rows)."""
        if not isinstance(records, DataFrame):
            names = self.schema.names
            rows = [tuple(r.get(n) for n in names) if isinstance(r, dict) else tuple(r) for r in records]
            records = self.spark.createDataFrame(rows, self.schema)
        missing = [n for n in self.schema.names if n not in records.columns]
        if missing:
            raise EngineError(f"snapshot: rows lack the columns {', '.join(missing)}")
        part = f"data/{uuid.uuid4().hex}"
        seen = Observation()
        typed = records.select(*[records[f.name].cast(f.dataType) for f in self.schema.fields])
        typed.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{part}")
        return [f"{part}/{n}" for n in self.folder.names(part) if n.endswith(".parquet")], seen.get["n"]

    def _publish(self, commit: dict[str, Any]) -> int:
        """Make a commit visible, all of it at once, or fail if its version is taken."""
        if "batches" not in commit:
            commit["batches"] = self._commit(commit["version"] - 1)["batches"] if commit["version"] else {}
        stamped = commit | {"timestamp": datetime.now(timezone.utc).isoformat()}
        if not self.folder.publish(_log(commit["version"]), json.dumps(stamped)):
            raise EngineError(f"snapshot: version {commit['version']} of {self.path} was written by someone else; try again")
        return commit["version"]
