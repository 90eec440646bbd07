"""An event pipeline that runs on streams and on tables alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.ids import uuid5
from millrace.operators.quality import Rule, validate
from millrace.sources.tables import VersionedTable


def json_stream(spark: SparkSession, path: str, per_trigger: int = 50) -> DataFrame:
    """Raw messages from new files of JSON lines: ``value``."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)


def decode(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed messages and the broken ones."""
    full = T.StructType.fromDDL(schema).add("_corrupt", T.StringType())
    p = raw.withColumn("r", F.from_json("value", full, {"columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return p.where(~broken).select("r.*").drop("_corrupt"), p.where(broken).select("value")


def transform(events: DataFrame, rules: Sequence[Rule], entity: str, day: str, facts: DataFrame | None = None) -> DataFrame:
    """The same steps for streams and backfills: identifier, validation flag, enrichment from a static table.

    Invalid rows pass with ``is_valid`` false. ``facts`` is joined by ``day`` and has to be unique there.
    """
    out = events.withColumn("event_id", uuid5(F.concat_ws("-", F.col(entity), F.substring(F.col(day).cast("string"), 1, 10))))
    out = validate(out, rules).withColumn("is_valid", F.size("validation_errors") == 0)
    return out.join(facts, day, "left") if facts is not None else out


def deduplicated(events: DataFrame, at: str, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; state older than the delay is dropped."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def tumbling(events: DataFrame, at: str, size: str, by: Sequence[str], measures: dict, delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Aggregates per tumbling window, or per sliding window with ``slide``."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = events.withWatermark(at, delay).groupBy(w.alias("w"), *by).agg(*[c.alias(n) for n, c in measures.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *measures)


def session_windows(events: DataFrame, at: str, gap: str, by: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """Sessions per key by inactivity gap: ``start, end, events``."""
    out = events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "events")


def rate_limited(events: DataFrame, key: str, at: str, most: int, seconds: int = 3600) -> DataFrame:
    """Each event with ``allowed``: whether its key had fewer than ``most`` allowed events in the time before.

    The state of a key is at most ``most`` times, whatever its traffic.
    """
    kind = dict(events.dtypes)[key]

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("at")
        allowed = []
        for t in rows["at"].astype("int64") // 1000 if str(rows["at"].dtype).endswith("[ns]") else rows["at"].astype("int64"):
            held = [x for x in held if x > t - seconds * 1_000_000]
            allowed.append(len(held) < most)
            if allowed[-1]:
                held.append(int(t))
        state.update((held,))
        yield rows.assign(key=k[0], allowed=allowed)[["key", "at", "allowed"]]

    src = events.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"))
    return src.groupBy("key").applyInPandasWithState(step, f"key {kind}, at timestamp, allowed boolean", "held array<bigint>", "append", GroupStateTimeout.NoTimeout)


def ordered_fold(turns: DataFrame, key: str, order: str, step: Callable[[dict, dict], tuple[dict, dict]], schema: str) -> DataFrame:
    """Fold the rows of each key in order with a state: ``step(state, row) -> (state, output)``.

    The batch form of a keyed conversation state; a conversation is the group, so it has to fit a task.
    """

    names = T.StructType.fromDDL(schema).names

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        out = []
        for row in pdf.sort_values(order, kind="stable").to_dict("records"):
            state, produced = step(state, row)
            out.append(produced)
        return pd.DataFrame(out, columns=names)

    return turns.groupBy(key).applyInPandas(run, schema)


def upsert_sink(
    events: DataFrame, table: VersionedTable, keys: Sequence[str], order: Sequence[str], checkpoint: str,
    rejects: str | None = None, interval: str | None = None,
) -> StreamingQuery:
    """Write each micro batch by upsert, and invalid rows to a dead-letter folder, with the counts of every batch beside it.

    A batch that fails is tried again from the checkpoint, and the upsert makes a repetition harmless.
    Without ``interval`` everything available is processed and the query ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        good = batch.where("is_valid") if "is_valid" in batch.columns else batch
        if rejects and "is_valid" in batch.columns:
            bad = batch.where("NOT is_valid").withColumn("validation_errors", F.concat_ws("; ", "validation_errors"))
            bad.write.mode("overwrite").json(f"{rejects}/batch={number}")
            run_counters(batch).write.mode("overwrite").json(f"{rejects}_counts/batch={number}")
        table.upsert(good.drop("validation_errors", "is_valid"), keys, order)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def run_counters(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summary of a run: ``rows, valid, rejected`` per group."""
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("rejected")
    )


def messages(events: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Events as ``key, value, headers`` for a message sink."""
    headers = F.array(*[F.struct(F.lit(a).alias("key"), F.encode(F.col(a).cast("string"), "UTF-8").alias("value")) for a in attributes])
    return events.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"), headers.alias("headers"))


def session_sink(events: DataFrame, table, user: str, event: str, at: str, received: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep a ``SessionTable`` up to date from a stream: each micro batch is one batch of the table.

    A batch that is delivered again changes nothing, since the table knows the events it has seen.
    """
    from millrace.operators.sessions import distinct_events

    def write(batch: DataFrame, _: int) -> None:
        table.apply(distinct_events(batch, user, event, at, received))

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def drain(query: StreamingQuery, timeout: float | None = None) -> None:
    """Let a query finish what is available and stop it; its error is raised."""
    try:
        query.processAllAvailable() if query.isActive else query.awaitTermination(timeout)
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()


def looked_up(asked: DataFrame, key: str, facts: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Look every key up once: keys with their facts, and the memory ``key, found`` that also keeps the failures.

    Keys that the memory holds already, found or not, are not asked again.
    """
    keys = asked.select(key).where(F.col(key).isNotNull()).distinct()
    new = keys if known is None else keys.join(known.select(key), key, "left_anti")
    hits = facts.join(new, key, "left_semi")
    tried = new.join(hits.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return hits, tried if known is None else known.select(key, "found").unionByName(tried)
