"""Commit logs of tables on plain files: numbered manifests, each of which can be written once."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class CommitLog:
    """Numbered JSON files below ``path/log``; the one with the highest number is the current manifest.

    A version is written aside and renamed to its number, which fails if the number exists, so no
    writer overwrites what another one has committed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self.at(self.path).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at(self.path).toUri(), conf)
        self._rename = jvm.org.apache.hadoop.fs.Options.Rename

    def _read(self, path) -> object:
        stream = self.fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def last(self) -> dict | list | None:
        """The current manifest, or None."""
        folder = self.at(f"{self.path}/log")
        if not self.fs.exists(folder):
            return None
        names = sorted(f.getPath().getName() for f in self.fs.listStatus(folder))
        names = [n for n in names if n.startswith("v") and n.endswith(".json")]
        return self._read(self.at(f"{self.path}/log/{names[-1]}")) if names else None

    def commit(self, version: int, manifest: dict | list) -> None:
        """Make ``manifest`` the current one; ``Conflict`` if there is one of that version already."""
        target = self.at(f"{self.path}/log/v{version:012d}.json")
        if self.fs.exists(target):
            raise Conflict(f"{self.path} has a version {version} already")
        aside = self.at(f"{self.path}/log/.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(aside, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        options[0] = self._rename.valueOf("NONE")
        try:
            self._files.rename(aside, target, options)
        except Exception as e:  # the error of the file system, by way of the JVM
            self.fs.delete(aside, False)
            if isinstance(e, PySparkException) or "AlreadyExists" in str(e) or self.fs.exists(target):
                raise Conflict(f"{self.path} has a version {version} already") from e
            raise

    def forget(self, keep: int = 1) -> None:
        """Delete all but the last ``keep`` manifests."""
        folder = self.at(f"{self.path}/log")
        names = sorted(f.getPath().getName() for f in self.fs.listStatus(folder)) if self.fs.exists(folder) else []
        for n in [n for n in names if n.startswith("v")][: -keep or None]:
            self.fs.delete(self.at(f"{self.path}/log/{n}"), False)
