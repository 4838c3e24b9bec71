"""Operators on ordered series: segments, as-of joins, blocks, lanes, reset segments, projections.

Series are ordered by time within their key (profile and window kind, or machine). What depends on the rows before is
a segmented scan over buckets of time, so a key with a long history is many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlark.operators.scan import Scan

MINUTE_US = 60_000_000
HOUR_US = 60 * MINUTE_US


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, bucket_us: int = 24 * HOUR_US) -> DataFrame:
    """left with the value of the latest right row at or before its time (null values are passed over).

    Both sides are sorted together within a key and a bucket of time, so a key with a long history is many tasks.
    What a bucket begins with comes from a table of one row for each key and bucket.
    """
    a = left.withColumns({"_side": F.lit(1), value: F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*keys, time, value).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col(time) / bucket_us))
    ends = both.groupBy(*keys, "_bucket").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(time))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select(*keys, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_begin"))
    w = Window.partitionBy(*keys, "_bucket").orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_side = 1")
    return filled.join(begins, [*keys, "_bucket"], "left").withColumn(value, F.coalesce(value, "_begin")).drop("_side", "_bucket", "_begin")


def lanes(events: DataFrame, gap_us: int = 5 * MINUTE_US, key: str = "machine_id") -> DataFrame:
    """Spans of activity: an event joins the span when it is at most gap_us after the one before."""
    opened = Scan(events.select(key, "us", "tokens"), [key]).runs({"_prev": "us"}, span=F.col("us") - F.col("_prev") > gap_us).frame()
    return opened.groupBy(key, "span").agg(F.min("us").alias("from_us"), F.max("us").alias("to_us"), F.count("*").alias("events"), F.sum("tokens").alias("tokens"))


def lane_overlaps(spans: DataFrame, least_us: int = 5 * MINUTE_US, bucket_us: int = 6 * HOUR_US, key: str = "machine_id") -> DataFrame:
    """Pairs of spans of different machines that overlap long enough, by an equi-join on time buckets."""
    cut = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("from_us") / bucket_us), F.floor(F.col("to_us") / bucket_us))))
    a = cut.select(F.col(key).alias("a"), F.col("from_us").alias("af"), F.col("to_us").alias("at"), "_b")
    b = cut.select(F.col(key).alias("b"), F.col("from_us").alias("bf"), F.col("to_us").alias("bt"), "_b")
    met = a.join(b, "_b").where("a < b AND af < bt AND bf < at")
    start, end = F.greatest("af", "bf"), F.least("at", "bt")
    # A pair meets in each bucket both cross; it counts in the one where the overlap starts.
    once = met.where(F.floor(start / bucket_us) == F.col("_b"))
    return once.select("a", "b", start.alias("from_us"), end.alias("to_us")).where(F.col("to_us") - F.col("from_us") >= least_us)


def split_at(spans: DataFrame, boundaries: DataFrame, bucket_us: int = 24 * HOUR_US, key: str = "machine_id") -> DataFrame:
    """Spans cut at the boundaries(boundary_us) that lie strictly inside them.

    Tokens and events are shared by duration, where a span counts a minute at least; intensity is a piece's rate over
    the largest one of all; pieces after a cut are carried over. Boundaries meet spans by bucket of time.
    """
    low, high = F.floor(F.col("from_us") / bucket_us), F.floor(F.col("to_us") / bucket_us)
    touched = spans.select(key, "span", "from_us", "to_us", F.explode(F.sequence(low, high)).alias("_b"))
    marks = boundaries.select("boundary_us", F.floor(F.col("boundary_us") / bucket_us).alias("_b")).distinct()
    inside = touched.join(marks, "_b").where("from_us < boundary_us AND boundary_us < to_us").groupBy(key, "span").agg(F.array_sort(F.collect_set("boundary_us")).alias("_cuts"))
    ends = spans.join(inside, [key, "span"], "left").withColumn("_at", F.concat(F.array("from_us"), F.coalesce("_cuts", F.array().cast("array<bigint>")), F.array("to_us")))
    pieces = ends.select("*", F.posexplode(F.slice("_at", F.lit(1), F.size("_at") - 1)).alias("_i", "_from")).withColumn("_to", F.element_at("_at", F.col("_i") + 2))
    share = (F.col("_to") - F.col("_from")) / F.greatest(F.lit(MINUTE_US), F.col("to_us") - F.col("from_us"))
    shared = pieces.withColumns({"_tokens": F.col("tokens") * share, "_events": F.floor(F.col("events") * share + 0.5)})
    rated = shared.withColumn("_rate", F.col("_tokens") / F.greatest(F.lit(MINUTE_US), F.col("_to") - F.col("_from")))
    top = rated.agg(F.max("_rate").alias("_top"))
    intensity = F.coalesce(F.try_divide("_rate", "_top"), F.lit(0.0))
    return rated.crossJoin(F.broadcast(top)).select(key, "span", F.col("_from").alias("from_us"), F.col("_to").alias("to_us"), F.round("_tokens", 4).alias("tokens"), F.col("_events").alias("events"), F.round(intensity, 6).alias("intensity"), (F.col("_i") > 0).alias("carried_over"))


def blocks(events: DataFrame, window_us: int = 5 * HOUR_US, key: str = "profile_id") -> DataFrame:
    """Usage blocks: a block starts at the UTC hour of its first event and ends window_us later.

    Only the hours that hold events matter, so events are counted by hour first (map-side); the fold then runs
    over the distinct hours of a profile, a number that time bounds and not the rows.
    """
    hours = events.groupBy(key, F.floor(F.col("us") / HOUR_US).alias("hour")).agg(F.count("*").alias("events"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    kind = events.schema[key].dataType.simpleString()
    width = window_us // HOUR_US

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("hour")
        starts, start = [], None
        for hour in group["hour"].tolist():
            if start is None or hour >= start + width:
                start = hour
            starts.append(start)
        group["start_us"] = [s * HOUR_US for s in starts]
        out = group.groupby([key, "start_us"], as_index=False).agg(first_us=("first_us", "min"), last_us=("last_us", "max"), events=("events", "sum"))
        out["end_us"] = out["start_us"] + window_us
        return out[[key, "start_us", "end_us", "first_us", "last_us", "events"]]

    return hours.groupBy(key).applyInPandas(fold, f"{key} {kind}, start_us long, end_us long, first_us long, last_us long, events long")


SERIES = ("profile_id", "window_kind")


def reset_segments(samples: DataFrame, keys: Sequence[str] = (*SERIES, "resets_us"), drop: float = 2.0, ties: Sequence[str] = ("pct",)) -> DataFrame:
    """samples with segment (a fall of `drop` points or more opens the next) and the previous sample's time; equal moments are in the order of ties, the lower first."""
    return Scan(samples, keys, ties=ties).runs({"prev_pct": "pct", "prev_us": "us"}, segment=F.col("prev_pct") - F.col("pct") >= drop).frame()


def cumulative_usage(samples: DataFrame, keys: Sequence[str] = (*SERIES, "resets_us"), ties: Sequence[str] = ("pct",)) -> DataFrame:
    """For each window: cumulative points (the sum of segment peaks), resets, and where the current segment starts."""
    cut = reset_segments(samples, keys, ties=ties)
    order = F.struct("us", *ties)
    peaks = cut.groupBy(*keys, "segment").agg(F.greatest(F.lit(0.0), F.max("pct")).alias("peak"), F.min_by("prev_us", order).alias("before"), F.min("us").alias("first"), F.max_by("pct", order).alias("last_pct"))
    return peaks.groupBy(*keys).agg(
        F.round(F.sum("peak"), 6).alias("cumulative_pct"),
        F.max("segment").alias("resets"),
        F.max_by(F.when(F.col("segment") > 0, F.col("before")).otherwise(F.col("first")), "segment").alias("current_start_us"),
        F.max_by("last_pct", "segment").alias("last_pct"),
    )


def samples_of_window(samples: DataFrame, windows: DataFrame, slack_us: int = 10 * MINUTE_US, keys: Sequence[str] = SERIES) -> DataFrame:
    """Samples that belong to each of windows(keys, end_us, start_us).

    A sample whose own reset is more than slack away is foreign; the window starts no earlier than its last
    foreign sample. Samples without a reset stay.
    """
    joined = samples.join(F.broadcast(windows), list(keys)).where("us >= start_us")
    foreign = F.col("resets_us").isNotNull() & (F.abs(F.col("resets_us") - F.col("end_us")) > slack_us)
    w = Window.partitionBy(*keys, "end_us")
    bounded = joined.withColumns({"_foreign": foreign, "effective_start_us": F.greatest(F.col("start_us"), F.coalesce(F.max(F.when(foreign, F.col("us"))).over(w), F.col("start_us")))})
    return bounded.where("NOT _foreign AND us >= effective_start_us").drop("_foreign")


def recent_rates(samples: DataFrame, now_us: int, keys: Sequence[str] = (*SERIES, "resets_us"), lookback_us: int = 30 * MINUTE_US, half_life_us: int = 10 * MINUTE_US) -> DataFrame:
    """By window: last_pct, the EWMA of recent rates in closed form (per minute), their quartiles low and high, and how many.

    Rates are those of neighbouring samples that rise or stay, taken in the look-back.
    """
    w = Window.partitionBy(*keys).orderBy("us")
    pairs = samples.where(F.col("us") <= now_us).withColumns({"_pu": F.lag("us").over(w), "_pp": F.lag("pct").over(w)})
    dt = (F.col("us") - F.col("_pu")) / MINUTE_US
    fine = (F.col("us") > F.col("_pu")) & (F.col("pct") >= F.col("_pp")) & (F.lit(now_us) - F.col("us") <= lookback_us)
    rated = pairs.withColumns({"_dt": F.when(fine, dt), "_r": F.when(fine, (F.col("pct") - F.col("_pp")) / dt)})
    h = half_life_us / MINUTE_US
    after = Window.partitionBy(*keys).orderBy(F.col("us").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.sum(F.when(F.col("_r").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    weighted = rated.withColumns({"_n": rank, "_later": F.coalesce(F.sum("_dt").over(after), F.lit(0.0))})
    decay = F.pow(F.lit(2.0), -F.col("_later") / h)
    share = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(1 - F.pow(F.lit(2.0), -F.col("_dt") / h))
    return weighted.groupBy(*keys).agg(
        F.max_by("pct", "us").alias("last_pct"),
        F.coalesce(F.sum(F.col("_r") * share * decay), F.lit(0.0)).alias("rate"),
        F.coalesce(F.percentile("_r", F.lit(0.25)), F.lit(0.0)).alias("low"),
        F.coalesce(F.percentile("_r", F.lit(0.75)), F.lit(0.0)).alias("high"),
        F.count("_r").alias("rates"),
    )


def project(samples: DataFrame, now_us: int, keys: Sequence[str] = (*SERIES, "resets_us"), end: str = "resets_us", lookback_us: int = 30 * MINUTE_US, half_life_us: int = 10 * MINUTE_US) -> DataFrame:
    """Projected percentage at the window's end from recent_rates, with a quartile band.

    Output by window: last_pct, rate (per minute), mid, lo and hi (clamped), eta_ms (null unless 100 is reached in time).
    """
    done = recent_rates(samples, now_us, keys, lookback_us, half_life_us)
    left = F.greatest((F.col(end) - F.lit(now_us)) / MINUTE_US, F.lit(0.0))
    to_full = (100 - F.col("last_pct")) / F.col("rate")
    clamp = lambda x: F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))
    return done.select(
        *keys,
        "last_pct",
        F.round("rate", 6).alias("rate"),
        F.round(clamp(F.col("last_pct") + F.col("rate") * left), 4).alias("mid_pct"),
        F.round(clamp(F.col("last_pct") + F.least("low", "rate") * left), 4).alias("lo_pct"),
        F.round(clamp(F.col("last_pct") + F.greatest("high", "rate") * left), 4).alias("hi_pct"),
        F.when((F.col("rate") > 0) & (F.col("last_pct") < 100), F.when(to_full <= left, F.floor((F.lit(now_us) + to_full * MINUTE_US) / 1000))).alias("eta_ms"),
        "rates",
    )


def multi_machine_overlap(events: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Share of a window's minutes in which two machines or more are active."""
    minutes = events.groupBy(*keys, start, end, F.floor((F.col("us") - F.col(start)) / MINUTE_US).alias("_m")).agg(F.countDistinct("machine_id").alias("_k"))
    total = F.greatest(F.lit(1), F.ceil((F.col(end) - F.col(start)) / MINUTE_US))
    return minutes.groupBy(*keys, start, end).agg(F.count_if(F.col("_k") >= 2).alias("_n")).select(*keys, start, F.round(F.col("_n") / total, 6).alias("overlap"))


def session_cut_rate(events: DataFrame, width_us: int, keys: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Share of sessions that a multiple of width_us falls strictly inside of."""
    spans = events.groupBy(*keys, "session_id").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    inside = (F.floor((F.col("b") - 1) / width_us) * width_us) > F.col("a")
    return spans.groupBy(*keys).agg(F.count("*").alias("sessions"), F.round(F.avg(F.when(inside, 1.0).otherwise(0.0)), 6).alias("cut_rate"))


def session_cuts(events: DataFrame, boundaries: DataFrame, keys: Sequence[str] = ("profile_id",)) -> DataFrame:
    """By key how many of its sessions one of the boundaries(keys, boundary_us) lies strictly inside of.

    The last boundary before a session's end decides it: if that is not after its start, none is inside.
    """
    spans = events.groupBy(*keys, "session_id").agg(F.min("us").alias("a"), F.max("us").alias("us"))
    marks = boundaries.select(*keys, (F.col("boundary_us") + 1).alias("us"), F.col("boundary_us").alias("_mark"))
    found = asof_backward(spans, marks, keys, "us", "_mark")
    cut = F.coalesce(F.col("_mark") > F.col("a"), F.lit(False))
    return found.groupBy(*keys).agg(F.count("*").alias("sessions"), F.count_if(cut).alias("cut_sessions"), F.round(F.avg(cut.cast("int")), 6).alias("cut_rate"))


def complete_ticks(series: DataFrame, first: int, last: int, step: int, tick: str, values: Sequence[str]) -> DataFrame:
    """Every tick from first to last with the series' values, 0 where it has none."""
    ticks = series.sparkSession.range(first, last + 1, step).withColumnRenamed("id", tick)
    return ticks.join(series, tick, "left").select(tick, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def downsample(df: DataFrame, keys: Sequence[str], order: str, most: int) -> DataFrame:
    """At most `most` rows of each series, both ends among them."""
    if most < 2:
        return df
    w = Window.partitionBy(*keys)
    numbered = df.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    # Row i is the k-th pick when i = round(k * (n - 1) / (most - 1)).
    k = F.floor(F.col("_i") * (most - 1) / (F.col("_n") - 1) + 0.5)
    picked = F.col("_i") == F.floor(k * (F.col("_n") - 1) / (most - 1) + 0.5)
    return numbered.where((F.col("_n") <= most) | picked).drop("_i", "_n")
