"""Versioned tables on plain files, and writers.

A table is a folder with one folder per version and a manifest that names the current one. Files are
never changed; a new version becomes visible when its manifest is renamed to its number, which only one writer can do.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.upsert import latest_per_key, merge
from millrace.runtime import cut
from millrace.sources.log import CommitLog

BUCKET = "_bucket"
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
"""JSON writers drop what is below a millisecond unless told otherwise."""


class VersionedTable:
    """Append, overwrite and upsert with history and reads of older versions."""

    def __init__(self, spark: SparkSession, path: str, partition_by: Sequence[str] = (), buckets: int = 0):
        """``buckets``: lay the rows out by a hash of the keys of ``upsert``, which then rewrites only the buckets it touches."""
        if partition_by and buckets:
            raise ValueError("a table has either partitions or buckets")
        self.spark, self.path, self.partition_by, self.buckets = spark, path.rstrip("/"), list(partition_by), buckets
        self._log = CommitLog(spark, self.path)
        self._fs = self._log.fs
        self._p = lambda x: self._log.at(f"{self.path}/{x}")

    def history(self) -> list[dict]:
        """Versions from the first to the current: ``version, operation, at, parts``."""
        return self._log.last() or []

    @property
    def version(self) -> int:
        log = self.history()
        return log[-1]["version"] if log else 0

    def exists(self) -> bool:
        return bool(self.history())

    # reading
    def read(self, version: int | None = None, as_of: float | None = None) -> DataFrame:
        """The current version, version ``version``, or the one that was current at the time ``as_of`` (seconds)."""
        log = self.history()
        if version is not None:
            log = [x for x in log if x["version"] == version]
        if as_of is not None:
            log = [x for x in log if x["at"] <= as_of]
        if not log:
            raise ValueError(f"{self.path} has no such version")
        return self._rows(log[-1]["parts"])

    def _rows(self, parts: Sequence[str]) -> DataFrame:
        if self.buckets:
            return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{p}" for p in parts])
        out = None
        for part in parts:
            one = self.spark.read.parquet(f"{self.path}/{part}")
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    # writing
    def _write(self, df: DataFrame, operation: str, keep: Sequence[str], parts: Sequence[str] | None = None, log: list | None = None) -> int:
        log = self.history() if log is None else log
        version = (log[-1]["version"] if log else 0) + 1
        part = f"v{version}-{uuid.uuid4().hex[:8]}"
        by = [BUCKET] if parts is not None else self.partition_by
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{part}")
        new = [part] if parts is None else [f"{part}/{x}" for x in parts if self._fs.exists(self._p(f"{part}/{x}"))]
        self._log.commit(version, [*log, {"version": version, "operation": operation, "at": time.time(), "parts": [*keep, *new]}])
        return version

    def overwrite(self, df: DataFrame) -> int:
        """Replace rows and schema."""
        return self._write(df, "overwrite", [])

    def append(self, df: DataFrame) -> int:
        """Add rows; new columns are allowed, older rows read as NULL there."""
        log = self.history()
        return self._write(df, "append", log[-1]["parts"] if log else [])

    def upsert(self, df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> int:
        """Merge by keys: matched rows are replaced, others added. The first call makes the table.

        With ``order`` the latest row of each key counts, within the batch and against the table, so
        late deliveries of older versions change nothing and a batch may be applied twice.
        """
        source = latest_per_key(df, keys, order) if order else df
        log = self.history()
        if self.buckets:
            return self._upsert_buckets(source, keys, order, log)
        if not log:
            return self._write(source, "upsert", [], log=log)
        return self._write(self._merged(self.read(), source, keys, order), "upsert", [], log=log)

    def _merged(self, target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
        if order:
            return latest_per_key(target.unionByName(source, allowMissingColumns=True), keys, order)
        return merge(target, source, keys)

    def _upsert_buckets(self, source: DataFrame, keys: Sequence[str], order: Sequence[str], log: list) -> int:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        source = cut(source)
        touched = {f"{BUCKET}={r[0]}" for r in source.select(bucket.alias("b")).distinct().collect()}  # at most ``buckets``
        parts = log[-1]["parts"] if log else []
        old = [p for p in parts if p.split("/")[-1] in touched]
        rows = self._merged(self._rows(old), source, keys, order) if old else source
        keep = [p for p in parts if p.split("/")[-1] not in touched]
        return self._write(rows.withColumn(BUCKET, bucket), "upsert", keep, sorted(touched), log)

    def restore(self, version: int) -> int:
        return self._write(self.read(version), "restore", [])

    def vacuum(self, keep: int = 1) -> None:
        """Forget all but the last ``keep`` versions and delete the parts that only they had."""
        log = self.history()
        kept = log[-keep:]
        used = {p for x in kept for p in x["parts"]}
        self._log.commit(kept[-1]["version"] + 1, [*kept[:-1], {**kept[-1], "version": kept[-1]["version"] + 1, "operation": "vacuum"}])
        self._log.forget()
        for p in {p for x in log for p in x["parts"]} - used:
            self._fs.delete(self._p(p), True)


def create_view(df: DataFrame, name: str, materialize: VersionedTable | None = None) -> DataFrame:
    """Register a layer as a view, or write it first and register what was written."""
    if materialize is not None:
        materialize.overwrite(df)
        df = materialize.read()
    df.createOrReplaceTempView(name)
    return df


def write_json_by_key(df: DataFrame, path: str, keys: Sequence[str], compression: str = "gzip") -> None:
    """JSON lines below ``key=value`` folders; only the folders of the batch are replaced, so a rerun repeats itself.

    Rows are laid out by the keys first, large keys in several parts, so a folder has few files.
    """
    (
        df.hint("rebalance", *[F.col(k) for k in keys]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).options(**EXACT)
        .partitionBy(*keys).json(path)
    )


def append_log(df: DataFrame, path: str, at: str) -> None:
    """Append to a log partitioned by day; writers do not disturb each other."""
    df.withColumn("log_date", F.col(at).cast("date")).write.mode("append").options(**EXACT).partitionBy("log_date").json(path)


def write_split(good: DataFrame, bad: DataFrame, path: str, rejects: str, keys: Sequence[str] = ()) -> None:
    """Valid rows to one place and rejected rows with their reasons to another."""
    writer = good.write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)
    bad.write.mode("overwrite").json(rejects)


def export(tables: dict[str, DataFrame], path: str, format: str = "csv") -> DataFrame:
    """Write each table anew and report ``table, rows`` as read back from what was written.

    An ``Observation`` would save the reading, but a session that has made one cannot send fitted models to its tasks any more.
    """
    spark = next(iter(tables.values())).sparkSession
    seen = []
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", "true").format(format).save(f"{path}/{name}")
        back = spark.read.format(format).option("header", "true").option("multiLine", str(format == "csv").lower())
        seen.append((name, back.load(f"{path}/{name}").count()))
    return spark.createDataFrame(seen, "table string, rows bigint")


def stamped(df: DataFrame, **values) -> DataFrame:
    """Add literal audit columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def create_tables(spark: SparkSession, tables: dict[str, tuple[str, str]]) -> None:
    """Create external tables ``name: (columns, path)`` where they do not exist yet, in the order given."""
    for name, (columns, path) in tables.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{path}'")


def drop_tables(spark: SparkSession, names: Sequence[str]) -> None:
    """Drop tables, those that others refer to last: the reverse of the order of their creation."""
    for name in reversed(list(names)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def version_counts(table: VersionedTable) -> DataFrame:
    """Rows of every version that can be read: ``version, operation, rows``."""
    out = None
    for x in table.history():
        one = table.read(x["version"]).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(x["version"]).alias("version"), F.lit(x["operation"]).alias("operation"), "rows")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return table.spark.createDataFrame([], "version int, operation string, rows bigint")
    return out


def dead_letters(path: str, keys: Sequence[str], values: Sequence[str]) -> tuple[str, str]:
    """The folder of a partition and its twin for rejected rows."""
    below = "/".join(f"{k}={v}" for k, v in zip(keys, values))
    return f"{path}/{below}", f"{path}_dead/{below}"


def upload(spark: SparkSession, files: Sequence[str], path: str, day: str) -> list[str]:
    """Copy files of the driver below ``path/day`` in whatever file system it names; files of the same name are replaced."""
    at = CommitLog(spark, path).at
    folder = at(f"{path}/{day}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    out = []
    for f in files:
        target = f"{path}/{day}/{f.rsplit('/', 1)[-1]}"
        fs.copyFromLocalFile(False, True, at(f"file:{f}"), at(target))
        out.append(target)
    return out
