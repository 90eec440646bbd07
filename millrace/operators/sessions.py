"""Sessions of events separated by inactivity (problem 3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.scan import carried
from millrace.runtime import cut, scratch
from millrace.sources.log import CommitLog

SCHEMA = "user_id bigint, start timestamp_ntz, end timestamp_ntz, first_event_id string, last_event_id string, events bigint"


def _micros(c: str | Column) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def bridge(sessions: DataFrame, gap_minutes: float = 30) -> DataFrame:
    """Merge sessions of a user that lie within the gap of one another, in any number of steps.

    Input and output have the columns of ``SCHEMA``. Single events are sessions of one event, so this
    is also how events become sessions. Two sessions belong together if the later one starts no more
    than the gap after everything before it has ended; chains of them are bridged into one.

    A user is divided into days, and only one row per user and day (the latest end, then the latest
    session start) passes from one day to the next, so a user that holds a third of all rows is worked
    on by as many tasks as it has days.
    """
    gap = int(gap_minutes * 60_000_000)
    rows = sessions.withColumn("day", F.col("start").cast("date")).withColumn("s", _micros("start")).withColumn("e", _micros("end"))
    order = [F.col("s"), F.col("first_event_id")]
    inside = Window.partitionBy("user_id", "day").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)

    ends = carried(rows, ["user_id"], "day", {"carried_end": F.max("e")}, {"carried_end": "max"})
    rows = rows.withColumn("end_here", F.max("e").over(before)).join(ends, ["user_id", "day"])
    reached = F.greatest("end_here", "carried_end")
    rows = cut(rows.withColumn("opens", F.when(reached.isNull() | (F.col("s") - reached > gap), F.col("s"))).drop("end_here", "carried_end"))
    opened = carried(rows, ["user_id"], "day", {"carried_open": F.max("opens")}, {"carried_open": "max"})
    rows = rows.withColumn("open_here", F.max("opens").over(upto)).join(opened, ["user_id", "day"])
    return (
        rows.withColumn("session", F.coalesce("open_here", "carried_open"))
        .groupBy("user_id", "session")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.min_by("first_event_id", F.struct("s", "first_event_id")).alias("first_event_id"),
            F.max_by("last_event_id", F.struct("e", "last_event_id")).alias("last_event_id"),
            F.sum("events").alias("events"),
        )
        .drop("session")
    )


def local_sessions(events: DataFrame, gap_minutes: float = 30) -> DataFrame:
    """Sessions of single events within a user and day; what reaches over midnight is left to ``bridge``.

    Only the first and the last event of each session leave the window, side by side, so a session is read off
    its first event's row: no group is formed.
    """
    gap = int(gap_minutes * 60_000_000)
    rows = events.select("user_id", "first_event_id", "start", F.col("start").cast("date").alias("day"), _micros("start").alias("s"))
    order = Window.partitionBy("user_id", "day").orderBy("s", "first_event_id")
    before, after = F.col("s") - F.lag("s").over(order), F.lead("s").over(order) - F.col("s")
    marked = rows.withColumns(
        {"opens": F.coalesce(before > gap, F.lit(True)), "ends": F.coalesce(after > gap, F.lit(True)), "n": F.row_number().over(order)}
    ).where("opens OR ends")
    other = lambda c: F.when(F.col("ends"), F.col(c)).otherwise(F.lead(c).over(order))
    paired = marked.select(
        "user_id", "start", other("start").alias("end"), "first_event_id", other("first_event_id").alias("last_event_id"),
        (other("n") - F.col("n") + 1).cast("bigint").alias("events"), "opens",
    )
    return paired.where("opens").drop("opens")


def with_session_start(df: DataFrame, user: str, at: str, gap_seconds: float, name: str = "session") -> DataFrame:
    """Add when the session of each event began, in microseconds; an event ``gap_seconds`` or more after the one before begins a new one.

    Users are divided into days as in ``bridge``, so no user is sorted in one task. Rows without user or time are left out.
    """
    gap = int(gap_seconds * 1_000_000)
    rows = df.where(F.col(user).isNotNull() & F.col(at).isNotNull()).withColumn("_day", F.col(at).cast("date")).withColumn("_t", _micros(at))
    inside = Window.partitionBy(user, "_day").orderBy("_t")
    ends = carried(rows, [user], "_day", {"_end": F.max("_t")}, {"_end": "max"})
    rows = rows.withColumn("_prev", F.lag("_t").over(inside)).join(ends, [user, "_day"])
    before = F.coalesce("_prev", "_end")
    rows = rows.withColumn("_opens", F.when(before.isNull() | (F.col("_t") - before >= gap), F.col("_t"))).drop("_prev", "_end")
    opened = carried(rows, [user], "_day", {"_carried": F.max("_opens")}, {"_carried": "max"})
    rows = rows.withColumn("_here", F.max("_opens").over(inside.rangeBetween(Window.unboundedPreceding, 0))).join(opened, [user, "_day"])
    return rows.withColumn(name, F.coalesce("_here", "_carried")).drop("_day", "_t", "_opens", "_here", "_carried")


def distinct_events(events: DataFrame, user: str, event: str, at: str, received: str | None = None) -> DataFrame:
    """Events as sessions of one event. Of repeats of an event id the first received counts.

    Rows with a NULL user, time or event id are left out: they belong to no session.
    """
    rows = events.select(
        F.col(user).cast("bigint").alias("user_id"),
        F.col(at).cast("timestamp_ntz").alias("at"),
        F.col(event).cast("string").alias("event_id"),
        F.col(received or at).alias("received"),
    ).where("user_id IS NOT NULL AND at IS NOT NULL AND event_id IS NOT NULL")
    first = rows.repartition("event_id").groupBy("event_id").agg(F.min_by(F.struct("user_id", "at"), F.struct("received", "at", "user_id")).alias("x"))
    return first.select(
        "x.user_id", F.col("x.at").alias("start"), F.col("x.at").alias("end"),
        F.col("event_id").alias("first_event_id"), F.col("event_id").alias("last_event_id"), F.lit(1).cast("bigint").alias("events"),
    )


def sessionize(events: DataFrame, user: str, event: str, at: str, received: str | None = None, gap_minutes: float = 30) -> DataFrame:
    """All sessions of a complete table of events at once; ``SCHEMA``."""
    return bridge(local_sessions(distinct_events(events, user, event, at, received), gap_minutes), gap_minutes)


class SessionTable:
    """A session table that grows batch by batch and can be read between batches.

    Files are never changed. A bucket of users is a folder of Parquet files; the manifest says which
    folder of each bucket is valid. ``apply`` forms the sessions of the new batch, bridges them with
    the stored sessions of the buckets that the batch touches, writes those buckets anew and then
    adds the next version of the manifest by one atomic rename: a reader, a retry or a job that dies in between sees
    the old table or the new one, and of two writers of the same version the second fails (``Conflict``) and may
    apply its batch again. Events seen before (by id) are ignored, so a batch may be applied again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, gap_minutes: float = 30, buckets: int = 16):
        self.spark, self.path, self.gap, self.buckets = spark, path or scratch(spark, "sessions"), gap_minutes, buckets
        self._log = CommitLog(spark, self.path)
        self._path, self._fs = self._log.at, self._log.fs

    # manifest -----------------------------------------------------------------------------------
    def _manifest(self) -> dict:
        return self._log.last() or {"version": 0, "sessions": {}, "seen": []}

    # data ---------------------------------------------------------------------------------------
    def _bucket(self) -> Column:
        return F.pmod(F.hash("user_id"), F.lit(self.buckets))

    def read(self) -> DataFrame:
        """The sessions as of the last applied batch; ``SCHEMA``."""
        folders = sorted(self._manifest()["sessions"].values())
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*folders)

    def apply(self, batch: DataFrame) -> None:
        """Add a batch of events: the columns of ``distinct_events``."""
        old = self._manifest()
        version = old["version"] + 1
        fresh = batch
        if old["seen"]:
            seen = self.spark.read.schema("first_event_id string").parquet(*old["seen"])
            fresh = batch.join(seen, "first_event_id", "left_anti").select(*batch.columns)
        ids = f"{self.path}/seen/v{version}"
        local = f"{self.path}/local/v{version}"
        fresh.select("first_event_id", "user_id", "start").write.mode("overwrite").parquet(ids)
        fresh = self.spark.read.schema("first_event_id string, user_id bigint, start timestamp_ntz").parquet(ids)
        local_sessions(fresh, self.gap).withColumn("bucket", self._bucket()).write.mode("overwrite").parquet(local)
        found = self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(local)
        touched = sorted(r[0] for r in found.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        folders = dict(old["sessions"])
        if touched:
            stored = [folders[str(b)] for b in touched if str(b) in folders]
            rows = found.drop("bucket")
            if stored:
                rows = rows.unionByName(self.spark.read.schema(SCHEMA).parquet(*stored))
            rows = bridge(rows, self.gap)
            out = f"{self.path}/data/v{version}"
            rows.withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(out)
            folders |= {str(b): f"{out}/bucket={b}" for b in touched}
        self._log.commit(version, {"version": version, "sessions": folders, "seen": [*old["seen"], ids]})
        self._fs.delete(self._path(local), True)

    def vacuum(self) -> None:
        """Delete the folders that the manifest no longer names. Only call it when nobody reads an older version."""
        self._log.forget()
        valid = set(self._manifest()["sessions"].values())
        data = self._path(f"{self.path}/data")
        if not self._fs.exists(data):
            return
        for version in self._fs.listStatus(data):
            for folder in self._fs.listStatus(version.getPath()):
                name = folder.getPath().getName()
                if name.startswith("bucket=") and not any(v.endswith(f"/{version.getPath().getName()}/{name}") for v in valid):
                    self._fs.delete(folder.getPath(), True)


def batches_by_arrival(events: DataFrame, received: str, count: int) -> Sequence[DataFrame]:
    """Split a table into ``count`` batches of about equal span of arrival time; rows without one are in the first."""
    span = events.agg(F.min(received).alias("a"), F.max(received).alias("b")).first()
    if span.a is None:
        return [events]
    at, kind = F.col(received), dict(events.dtypes)[received]
    edges = [F.lit(span.a + (span.b - span.a) * i / count).cast(kind) for i in range(count)]
    out = []
    for i in range(count):
        late = at >= edges[i]
        before = at < edges[i + 1] if i + 1 < count else F.lit(True)
        out.append(events.where(at.isNull() | before if i == 0 else late & before))
    return out


def incremental_sessions(
    events: DataFrame, user: str, event: str, at: str, received: str, gap_minutes: float = 30, batches: int = 3
) -> DataFrame:
    """Sessions of a table whose rows are applied to a ``SessionTable`` in ``batches`` by arrival.

    Adds ``duration_seconds``. The batches give the same sessions as one pass over everything: late
    events extend or bridge sessions that are stored already.
    """
    stored = SessionTable(events.sparkSession, gap_minutes=gap_minutes)
    for batch in batches_by_arrival(events, received, batches):
        stored.apply(distinct_events(batch, user, event, at, received))
        stored.vacuum()
    return stored.read().withColumn("duration_seconds", (_micros("end") - _micros("start")) / F.lit(1e6))
