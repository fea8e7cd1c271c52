"""Append-only logs of rows with versions, for tables that streams and feeds write.

A version is a manifest, a small JSON file that names the folders of Parquet files which
make up the log.  A commit writes its rows to a folder of a new name, then renames the
next manifest into place.  Readers see a commit whole or not at all, and a reader that
has begun keeps its version.  A crash between the two leaves a folder that no manifest
names, and loses nothing.

Each row has the ``generation`` that brought it: the version in which it was added.  A
commit may carry the number of a stream's batch; a batch that comes again changes
nothing, and finds the version before it (``before``).  There is one writer at a time:
of two that race for a version, one fails on file systems whose rename refuses an
existing target.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage


class Log:
    """Rows of ``schema`` in ``folder``.  Version 0 is the empty log."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def versions(self) -> list[int]:
        found = (re.fullmatch(r"(\d{8})\.json", n) for n in storage.names(self.spark, f"{self.folder}/versions"))
        return [int(m[1]) for m in found if m]

    def latest(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        if not version:
            return {"version": 0, "folders": [], "batches": {}}
        return json.loads(storage.read_text(self.spark, f"{self.folder}/versions/{version:08d}.json"))

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default, with their ``generation``."""
        schema = f"{self.schema}, generation int"
        folders = self.manifest(version)["folders"]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/rows/{f}" for f in folders])

    def before(self, writer: str, batch: int) -> int:
        """The newest version that has nothing of this batch of a writer, nor of later ones."""
        for version in reversed(self.versions()):
            if self.manifest(version)["batches"].get(writer, -1) < batch:
                return version
        return 0

    def _write(self, rows: DataFrame) -> str:
        name = f"{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/rows/{name}")
        return name

    def _publish(self, manifest: dict) -> None:
        storage.publish(self.spark, f"{self.folder}/versions/{manifest['version']:08d}.json", json.dumps(manifest))

    def append(self, rows: DataFrame, writer: str = "", batch: int | None = None) -> int:
        """Commits ``rows``; returns the version that has them.  A batch that is there already isn't written again."""
        base = self.manifest()
        if batch is not None and base["batches"].get(writer, -1) >= batch:
            return base["version"]
        version = base["version"] + 1
        columns = [c.name for c in self.spark.createDataFrame([], self.schema).schema]
        folder = self._write(rows.select(*columns, F.lit(version).alias("generation")))
        batches = base["batches"] if batch is None else base["batches"] | {writer: batch}
        self._publish({"version": version, "folders": [*base["folders"], folder], "batches": batches})
        return version

    def compact(self, kept: Callable[[DataFrame], DataFrame]) -> int:
        """A version whose rows are those that ``kept`` picks from the latest version's, in one folder; generations stay."""
        base = self.manifest()
        rows = self.rows(base["version"])
        folder = self._write(kept(rows).select(*rows.columns))
        version = base["version"] + 1
        self._publish({"version": version, "folders": [folder], "batches": base["batches"]})
        return version

    def expire(self, oldest: int) -> None:
        """Removes versions below ``oldest`` (the latest stays) and folders that no version names any more.  No writer may be at work."""
        for version in self.versions():
            if version < min(oldest, self.latest()):
                storage.remove(self.spark, f"{self.folder}/versions/{version:08d}.json")
        named = {f for v in self.versions() for f in self.manifest(v)["folders"]}
        for name in storage.names(self.spark, f"{self.folder}/rows"):
            if name not in named:
                storage.remove(self.spark, f"{self.folder}/rows/{name}")


def latest_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key, the rows of its newest generation."""
    newest = rows.groupBy(*keys).agg(F.max("generation").alias("generation"))
    return rows.join(newest, [*keys, "generation"], "left_semi")
