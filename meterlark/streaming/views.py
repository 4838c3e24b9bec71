"""Views that a stream keeps up to date: the hourly rollup by retraction, and usage blocks with event-time timers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from meterlark.functions.scalars import usage_rank
from meterlark.operators.ordered import HOUR_US
from meterlark.operators.usage import COUNTED, hourly_rows
from meterlark.sources.store import Store, merge_sums
from meterlark.streaming.pipelines import LATE, _started, stateful

# --- the hourly rollup ------------------------------------------------------------------------------------

GROUP = ("profile_id", "machine_id", "model", "hour_us", "session_id")
CONTRIBUTION = ", ".join(["profile_id string", "machine_id string", "model string", "hour_us long", "session_id string", *(f"{c} long" for c in COUNTED)])
_NAMES = [*GROUP, *COUNTED]


def _plain(x):
    """A value of a pandas row as Python has it."""
    return x if x is None or isinstance(x, str) else int(x)


class Contributions(StatefulProcessor):
    """What a record adds to its hour: when a fuller one replaces it, the old contribution is taken back.

    The state of a key is its rank and what it contributes now. The hour, machine, profile and session are those of
    the first arrival; a record without a request id is never replaced.
    """

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", f"rank long, {CONTRIBUTION}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.held.get() if self.held.exists() else None
        now = before
        batch = pd.concat(list(rows)).sort_values(["arrival", "event_id"], kind="stable")
        for rank, replaceable, *told in batch[["rank", "replaceable", *_NAMES]].itertuples(index=False, name=None):
            told = tuple(map(_plain, told))
            if now is None:
                now = (int(rank), *told)
            elif replaceable and rank > now[0]:
                now = (int(rank), *now[1 : 1 + len(GROUP)], *told[len(GROUP) :])
        if now == before:
            return
        self.held.update(now)
        out = [now[1:]]
        if before is not None:
            out.append((*before[1 : 1 + len(GROUP)], *(-x for x in before[1 + len(GROUP) :])))
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def contributions(feed: DataFrame) -> DataFrame:
    """feed(usage columns, cost_usd, arrival, event_id) as signed contributions to the hours of hourly_rows().

    A state knows one key, so records without a request id are told apart by their message alone; the store's read
    path also refuses one whose content an earlier message had.
    """
    keyed = F.col("request_id") != ""
    rows = hourly_rows(feed.withColumns({"rank": usage_rank().cast("long"), "replaceable": keyed, "dedup_key": F.concat_ws("|", "message_id", "request_id")}), ("dedup_key", "rank", "replaceable", "arrival", "event_id"))
    return stateful(rows).groupBy("dedup_key").transformWithStateInPandas(Contributions(), CONTRIBUTION, "Update", "None")


def hourly_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, merge_sums([*GROUP], [*COUNTED]))


def maintain_hourly(feed: DataFrame, view: str, checkpoint: str, interval: str | None = None, compact_every: int = 8) -> StreamingQuery:
    """Keep the hourly rollup of a feed: each batch appends what it changes, and runs of batches are merged."""

    def write(batch: DataFrame, epoch: int) -> None:
        store = hourly_store(batch.sparkSession, view)
        store.append(batch.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in COUNTED]), epoch)
        if (epoch + 1) % compact_every == 0:
            store.compact(compact_every)

    return _started(contributions(feed).writeStream.outputMode("update").foreachBatch(write), checkpoint, interval)


def hourly_view(store: Store) -> DataFrame:
    """The rollup that a store holds, as operators.usage.hourly_view makes it from all records."""
    from meterlark.operators.usage import rolled_up

    return rolled_up(store.read())


# --- usage blocks -----------------------------------------------------------------------------------------

BLOCK = "start_us long, end_us long, first_us long, last_us long, events long, change string, version long"
_BLOCK = [c.split()[0] for c in BLOCK.split(", ")]


class OpenBlocks(StatefulProcessor):
    """Blocks of a profile as its events come, in any order.

    The state holds the hours with events that may still change: events, first and last moment of each, and the hour
    that the next block may begin at. An event that falls between blocks re-splits those after it; blocks that vanish
    are deleted, changed ones are written again, each change with a rising version. When the watermark has passed the
    end of the earliest block, a timer makes it final and its hours leave the state.
    """

    def __init__(self, window_us: int, key: str, kind: str):
        self.width, self.key = window_us // HOUR_US, key
        self.kind = kind

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("blocks", "json string")

    def _load(self) -> dict:
        held = json.loads(self.state.get()[0]) if self.state.exists() else {"hours": {}, "from": None, "shown": {}, "version": 0}
        held["hours"] = {int(h): v for h, v in held["hours"].items()}
        held["shown"] = {int(h): v for h, v in held["shown"].items()}
        return held

    def _blocks(self, hours: dict[int, list[int]]) -> dict[int, list[int]]:
        out, start = {}, None
        for h in sorted(hours):
            n, first, last = hours[h]
            if start is None or h >= start + self.width:
                start = h
                out[start] = [first, last, n]
            else:
                b = out[start]
                out[start] = [min(b[0], first), max(b[1], last), b[2] + n]
        return out

    def _settle(self, key, held: dict, watermark_ms: int) -> Iterator[pd.DataFrame]:
        blocks, rows = self._blocks(held["hours"]), []

        def tell(start: int, b: list[int], change: str) -> None:
            held["version"] += 1
            rows.append((key[0], start * HOUR_US, (start + self.width) * HOUR_US, *b, change, held["version"]))

        for start in sorted(set(held["shown"]) - set(blocks)):
            tell(start, held["shown"][start], "delete")
        for start, b in blocks.items():
            if held["shown"].get(start) != b:
                tell(start, b, "upsert")
        for start in sorted(blocks):
            end = start + self.width
            if end * HOUR_US > watermark_ms * 1000:
                break
            tell(start, blocks.pop(start), "final")
            held["hours"] = {h: v for h, v in held["hours"].items() if h >= end}
            held["from"] = end
        held["shown"] = blocks
        if blocks:
            self.handle.registerTimer((min(blocks) + self.width) * HOUR_US // 1000)
        self.state.update((json.dumps(held),))
        if rows:
            yield pd.DataFrame(rows, columns=[self.key, *_BLOCK])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._load()
        for batch in rows:
            us = batch["us"].astype("int64")
            for h, part in us.groupby(us // HOUR_US):
                if held["from"] is not None and h < held["from"]:
                    continue  # of a block that is final
                n, first, last = held["hours"].get(int(h), [0, int(part.min()), int(part.max())])
                held["hours"][int(h)] = [n + len(part), min(first, int(part.min())), max(last, int(part.max()))]
        yield from self._settle(key, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, self._load(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def block_changes(events: DataFrame, window_us: int = 5 * HOUR_US, key: str = "profile_id", late: str = LATE) -> DataFrame:
    """events(key, ts, us) as changes of blocks: upsert and delete while they are open, final when the watermark has passed them."""
    kind = events.schema[key].dataType.simpleString()
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(key, "ts", "us")
    return stateful(timed).groupBy(key).transformWithStateInPandas(OpenBlocks(window_us, key, kind), f"{key} {kind}, {BLOCK}", "Update", "EventTime")


def current_blocks(changes: DataFrame, key: str = "profile_id") -> DataFrame:
    """The blocks that changes lead to: the newest version of each, without those deleted."""
    rest = [c for c in _BLOCK if c != "start_us"]
    newest = changes.groupBy(key, "start_us").agg(F.max_by(F.struct(*rest), "version").alias("b")).select(key, "start_us", "b.*")
    return newest.where("change <> 'delete'").select(key, "start_us", "end_us", "first_us", "last_us", "events")
