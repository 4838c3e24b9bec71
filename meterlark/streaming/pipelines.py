"""Streams over the usage and quota feeds. Each takes a streaming frame and gives a streaming frame or a running query.

Delivery is at least once and every sink is idempotent: folders are named by the batch and replaced when a batch
runs again, and records are told apart by key and rank. The reports know no late data: a record counts whenever it
arrives. Streams with a watermark give that up after `LATE`, which the batch read path does not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from meterlark.functions.scalars import counts_toward_quota, dedup_key, quota_tokens, usage_rank
from meterlark.operators import rollout
from meterlark.sources.store import Store, stored_records
from meterlark.sources.wire import decode_events, sse_frame

#: How long windowed streams wait for late records.
LATE = "7 days"
#: Processors with states of their own need a state store that has column families.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DEFAULT_PROVIDER = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
COLUMN_FAMILIES = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How far ahead of the clock a record may be.
AHEAD_US = 300_000_000


def _started(writer, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Run over what is there, or every interval where one is given."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def stateful(frame: DataFrame) -> DataFrame:
    """frame, whose session is told to keep states in a store with column families if it has none chosen.

    The store is read from the session when a query starts. One that was chosen and cannot do it is an error here,
    not in the tasks of the query.
    """
    conf = frame.sparkSession.conf
    chosen = conf.get(PROVIDER, DEFAULT_PROVIDER)
    if chosen == DEFAULT_PROVIDER:
        conf.set(PROVIDER, COLUMN_FAMILIES)
    elif chosen != COLUMN_FAMILIES:
        raise ValueError(f"processors with state need {COLUMN_FAMILIES}, but {PROVIDER} is {chosen}")
    return frame


def guarded(now_us: Column | int, since_us: int | None = None, us: Column | None = None) -> Column:
    """Why a record is refused: too far in the future, or before the day collection starts; null where it is not."""
    at = F.col("us") if us is None else us
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    early = F.lit(False) if since_us is None else at < since_us
    return F.when(at > now + AHEAD_US, "future").when(early, "before_start")


# --- ingest ---------------------------------------------------------------------------------------------


def ingest(lines: DataFrame, store: str, checkpoint: str, interval: str | None = None, since_us: int | None = None, now_us: int | None = None) -> StreamingQuery:
    """Decode transport lines(value) into a store of records; lines that are invalid or refused go to its quarantine, with the reason.

    A bad line is set aside alone, so a batch is never refused for it. Each batch is an epoch of the store, which takes
    it once; records keep the order that they came in. Now is the clock's, unless told.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        now = F.unix_micros(F.current_timestamp()) if now_us is None else now_us
        decoded = decode_events(batch.select("value", F.col("value").alias("line")))
        told = decoded.withColumn("reason", F.when(F.col("invalid"), "invalid").otherwise(guarded(now, since_us, F.col("event.us"))))
        Store(batch.sparkSession, store).append_records(told.where("reason IS NULL").select("event.*"), epoch)
        told.where("reason IS NOT NULL").select("line", "reason").write.mode("overwrite").parquet(f"{store}/quarantine/epoch={epoch}")

    return _started(lines.writeStream.foreachBatch(write), checkpoint, interval)


def stored_usage(spark: SparkSession, store: str) -> DataFrame:
    """What the store holds: one row for each record, by rank and first arrival, merged as it is read."""
    return stored_records(Store(spark, store))


# --- stateful deduplication ---------------------------------------------------------------------------------


class BestOfKey(StatefulProcessor):
    """Keeps the rank and row of a key and gives a row on only when it is new or ranks higher."""

    def __init__(self, schema: str):
        self.schema = schema

    def init(self, handle) -> None:
        self.best = handle.getValueState("best", "rank long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.best.get()[0] if self.best.exists() else None
        batch = pd.concat(list(rows)).sort_values(["rank", "arrival"], ascending=[False, True], kind="stable")
        top = batch.iloc[:1]
        if held is None or int(top["rank"].iloc[0]) > held:
            self.best.update((int(top["rank"].iloc[0]),))
            yield top.assign(change="insert" if held is None else "update")

    def close(self) -> None:
        pass


def best_records(feed: DataFrame) -> DataFrame:
    """feed(usage columns, arrival) as changes: the rows that insert a key or replace a lesser record of it."""
    ranked = feed.select(dedup_key().alias("dedup_key"), usage_rank().alias("rank"), "arrival", "machine_id", "profile_id", "output_tokens")
    fields = "dedup_key string, rank long, arrival long, machine_id string, profile_id string, output_tokens long, change string"
    typed = ranked.withColumns({"rank": F.col("rank").cast("long"), "arrival": F.col("arrival").cast("long")})
    return stateful(typed).groupBy("dedup_key").transformWithStateInPandas(BestOfKey(fields), fields, "Update", "None")


# --- windows --------------------------------------------------------------------------------------------


def hourly(usage: DataFrame, late: str = LATE) -> DataFrame:
    """Tumbling hours by profile and model; an hour is final when the watermark has passed it."""
    timed = usage.where(counts_toward_quota()).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour"), "profile_id", "model").agg(F.count("*").alias("events"), F.sum(quota_tokens()).alias("total_tokens")).select(F.col("window.start").alias("hour"), "profile_id", "model", "events", "total_tokens")


def session_lanes(usage: DataFrame, gap: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Spans of activity by machine as session windows; a span ends with its last event, not with the gap after it."""
    timed = usage.withWatermark("ts", late)
    spans = timed.groupBy(F.session_window("ts", gap), "machine_id").agg(F.min("us").alias("from_us"), F.max("us").alias("to_us"), F.count("*").alias("events"))
    return spans.select("machine_id", "from_us", "to_us", "events")


class ChangeOnly(StatefulProcessor):
    """Gives a sample of a series on only when its value differs from the one before."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "us long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, value = self.last.get() if self.last.exists() else (None, None)
        batch, kept = pd.concat(list(rows)).sort_values("us", kind="stable"), []
        for row in batch.itertuples(index=False):
            if (at is None or row.us > at) and (at is None or row.value != value):
                kept.append((key[0], row.us, row.value))
                at, value = int(row.us), row.value
        if kept:
            self.last.update((at, value))
            yield pd.DataFrame(kept, columns=["series", "us", "value"])

    def close(self) -> None:
        pass


def changes(samples: DataFrame) -> DataFrame:
    """samples(series, us, value) where the value changes: the points of a timeline."""
    return stateful(samples).groupBy("series").transformWithStateInPandas(ChangeOnly(), "series string, us long, value string", "Append", "None")


def changes_batch(samples: DataFrame) -> DataFrame:
    """changes() over a table."""
    from pyspark.sql import Window

    w = Window.partitionBy("series").orderBy("us")
    return samples.withColumn("_p", F.lag(F.struct("value")).over(w)).where(F.col("_p").isNull() | ~F.col("value").eqNullSafe(F.col("_p.value"))).drop("_p")


# --- updates --------------------------------------------------------------------------------------------


def window_updates(quota: DataFrame, recompute: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """For each batch of quota samples the state of the windows that it touches, as server-sent events.

    recompute(touched) gives the current state of touched(profile_id, window_kind) from the store.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        touched = batch.select("profile_id", "window_kind").distinct()
        states = recompute(touched)
        frames = states.select("profile_id", sse_frame("window_update", F.struct(*states.columns)).alias("frame"))
        counts = batch.groupBy("profile_id").agg(F.count("*").alias("samples"), F.max("us").alias("last_us"))
        batches = counts.select("profile_id", sse_frame("event_batch", F.struct("profile_id", "samples", "last_us")).alias("frame"))
        frames.unionByName(batches).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return _started(quota.writeStream.foreachBatch(write), checkpoint, interval)


def write_stream(frame: DataFrame, out: str, checkpoint: str, mode: str = "append", interval: str | None = None) -> StreamingQuery:
    """Append a stream to Parquet, or in update mode a folder of changes for each batch."""
    if mode == "append":
        return _started(frame.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint, interval)
    return _started(frame.writeStream.outputMode(mode).foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")), checkpoint, interval)


def stream_rollouts(lines: DataFrame, out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Rollout lines(path, pos, value) as events and warnings; the machine of each file is the state of its path."""
    parsed = stateful(lines).groupBy("path").transformWithStateInPandas(rollout.rollout_processor(), rollout.EVENT_SCHEMA, "Append", "None")
    return write_stream(parsed, out, checkpoint, "append", interval)
