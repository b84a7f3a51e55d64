"""The ledger of an incremental fact: what has been ingested, per batch and year.

A batch writes its rows to a folder of its own and then commits by one rename of a small file, so it is in the ledger whole or not at
all; rows of an uncommitted batch are never read. Nothing that is committed is rewritten: a year's current rows are those of
its highest committed version that could be read."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "batch long, year int, version int, path string, state string, rows long, quarantined long, error string, folder string"


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/_ledger"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, batch: int) -> str:
        return f"{self.root}/batch-{batch:012d}.json"

    def has(self, batch: int) -> bool:
        return self._fs.exists(self._path(self._file(batch)))

    def commit(self, batch: int, entries: list[dict]) -> None:
        """One file, written aside and renamed; a batch that is there already stays as it is."""
        if self.has(batch):
            return
        aside = self._path(f"{self.root}/_{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray("".join(json.dumps({"batch": batch, **e}) + "\n" for e in entries).encode()))
        finally:
            out.close()
        if not self._fs.rename(aside, self._path(self._file(batch))) and not self.has(batch):
            raise OSError(f"batch {batch} could not be committed")

    def table(self) -> DataFrame:
        """One row for a batch and year; state: "read", "superseded" (not newer than what was there, left out) or "failed" (with
        ``error``)."""
        if not self._fs.exists(self._path(self.root)):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).json(self.root)

    def current(self) -> dict[int, dict]:
        """Per year the entry whose rows count: the highest version read, of equal ones the first."""
        out: dict[int, dict] = {}
        for r in sorted(self.table().where("state = 'read'").collect(), key=lambda r: (r["version"], -r["batch"])):  # years x batches
            out[r["year"]] = r.asDict()
        return out
