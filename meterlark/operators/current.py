"""Every current window in one answer, from two frames that are read once each: recent samples and recent events.

The samples of the look-back and the events of five weeks are cut to what the parts need and written to the shared
folder; segments, projections, attribution, users and the cost of a full window are made from these two. Both are
bounded by time, not by how long the history is.

A window is told by nearness: the vendor's reset times of one window differ by up to some seconds between answers, so
resets at most ten minutes apart are the same window, and a sample without a reset stays with the window around it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.functions.scalars import clamp_pct, waste_pct, window_label, window_us
from meterlark.operators import attribution, calendar, ordered, windows
from meterlark.operators.ordered import HOUR_US, MINUTE_US, SERIES, asof_backward
from meterlark.operators.scan import DAY_US, Scan
from meterlark.sources.shared import written

SLACK_US = 10 * MINUTE_US
WEEK_US = 7 * DAY_US
#: How far back ratios and product shares look, and how many weeks weekday weights are made from (fixed values).
LOOKBACK_US, WEIGHT_WEEKS = 14 * DAY_US + 5 * HOUR_US, 4
#: Windows up to this long say who used them; longer ones of a week are projected by weekday.
SHORT_US = 6 * HOUR_US
STALE_US = 15 * MINUTE_US


def identify_windows(samples: DataFrame, keys: Sequence[str] = SERIES, slack_us: int = SLACK_US) -> DataFrame:
    """samples(keys, us, resets_us) with window_us, the end of the window that a sample belongs to.

    Reset times are chained: one at most slack after the one before is the same window's. Its end is what the latest
    of its samples says. A sample without a reset belongs to the window last seen before it, as long as that lasts;
    otherwise window_us is null. The chain runs over distinct moments of a reset, not over samples.
    """
    resets = samples.where("resets_us IS NOT NULL").groupBy(*keys, "resets_us").agg(F.max("us").alias("us"))
    chained = Scan(resets, keys, "resets_us").runs({"_before": "resets_us"}, _window=F.col("resets_us") - F.col("_before") > slack_us).frame()
    ends = chained.groupBy(*keys, "_window").agg(F.max_by("resets_us", F.struct("us", "resets_us")).alias("window_us"))
    named = chained.join(ends, [*keys, "_window"]).select(*keys, "resets_us", "window_us")
    found = samples.join(named, [*keys, "resets_us"], "left")
    held = Scan(found, keys).last(_held="window_us").frame()
    return held.withColumn("window_us", F.when(F.col("resets_us").isNotNull(), F.col("window_us")).when(F.col("us") < F.col("_held"), F.col("_held"))).select(*samples.columns, "window_us")


def latest_windows(samples: DataFrame, now_us: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """(keys, pct, captured_us, resets_us, end_us, width_us): the latest sample of each window and where the window ends.

    A window without a reset ends its own length from now.
    """
    last = samples.groupBy(*keys).agg(F.max_by(F.struct("pct", "us", "resets_us"), "us").alias("_s"))
    one = last.select(*keys, F.col("_s.pct").alias("pct"), F.col("_s.us").alias("captured_us"), F.col("_s.resets_us").alias("resets_us"), window_us().alias("width_us"))
    return one.withColumn("end_us", F.coalesce("resets_us", now_us + F.col("width_us")))


def own_samples(samples: DataFrame, latest: DataFrame, keys: Sequence[str] = SERIES, slack_us: int = SLACK_US) -> tuple[DataFrame, DataFrame]:
    """(samples of each latest window, latest with start_us).

    A sample whose own reset is more than slack away belongs to another window, and this one starts no earlier than
    the last such sample: a reset that opens a window early leaves samples of the old one after the nominal start.
    """
    near = samples.join(latest.select(*keys, "end_us", "width_us", F.col("resets_us").alias("_r")), [*keys]).where("us >= end_us - width_us")
    foreign = F.coalesce(F.abs(F.col("resets_us") - F.col("_r")) > slack_us, F.lit(False))
    marked = near.withColumn("_foreign", foreign)
    starts = marked.groupBy(*keys).agg(F.max(F.when(F.col("_foreign"), F.col("us"))).alias("_last"))
    bounded = latest.join(starts, [*keys], "left").withColumn("start_us", F.greatest(F.col("end_us") - F.col("width_us"), F.coalesce("_last", F.col("end_us") - F.col("width_us")))).drop("_last")
    own = marked.where("NOT _foreign").join(bounded.select(*keys, "start_us"), [*keys]).where("us >= start_us")
    return own.select(*keys, "us", "pct", "start_us", "end_us"), bounded


def _steps(own: DataFrame, events: DataFrame, drop: float, keys: Sequence[str] = SERIES) -> DataFrame:
    """own with segment, what the sample before was, and whether an event lies in the half hour before."""
    before = events.select("profile_id", (F.col("us") + 1).alias("us"), F.col("us").alias("_event")).distinct()
    seen = asof_backward(own, before, ["profile_id"], "us", "_event")
    stepped = Scan(seen, keys).runs({"prev_us": "us", "prev_pct": "pct"}, segment=F.col("prev_pct") - F.col("pct") >= drop).frame()
    # Only events of the window itself count, so that one just before its start is none of it.
    recent = (F.col("_event") >= F.col("us") - attribution.GAP_US) & (F.col("_event") >= F.col("start_us"))
    return stepped.withColumn("busy", F.coalesce(recent, F.lit(False))).drop("_event")


def _attributed(steps: DataFrame, bounded: DataFrame, series: DataFrame, scaled: DataFrame, now_us: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """By window what rose, what of it came from elsewhere for sure, what other products explain, and whether that can be used."""
    gap_us = attribution.GAP_US
    pair = F.col("us") > F.col("prev_us")
    far = pair & (F.col("us") - F.col("prev_us") > gap_us)
    rise = F.col("pct") - F.col("prev_pct")
    up = pair & ~far & (rise > 0)
    zero = F.lit(0.0)
    first = F.col("prev_us").isNull()
    facts = steps.groupBy(*keys).agg(
        F.round(F.coalesce(F.sum(F.when(up, rise)), zero), 6).alias("observed_pct"),
        F.round(F.coalesce(F.sum(F.when(up & ~F.col("busy"), rise)), zero), 6).alias("other_lower_pct"),
        F.round(F.coalesce(F.sum(F.when(up & F.col("busy"), rise)), zero), 6).alias("ambiguous_pct"),
        F.greatest(zero, F.max(F.when(first, F.col("pct")))).alias("unobserved_pct"),
        F.count_if(pair & ~far).alias("_spans"), F.count_if(up & ~F.col("busy")).alias("quiet_spans"), F.count_if(far).alias("_far"),
    )
    at = lambda what, a, b, most: F.struct(F.lit(what).alias("what"), a.alias("from_us"), b.alias("to_us"), most.cast("double").alias("most"))
    # Rises beside own events, and what was there before the first sample; at most each rise is explained.
    spans = steps.where((up & F.col("busy")) | (first & (F.col("pct") > 0) & (F.col("us") > F.col("start_us")))).select(*keys, F.when(first, at("unobserved", F.col("start_us"), F.col("us"), F.col("pct"))).otherwise(at("ambiguous", F.col("prev_us"), F.col("us"), rise)).alias("s"))
    whole = bounded.select(*keys, at("whole", F.col("start_us"), F.lit(now_us), F.lit(None)).alias("s"))
    risen = windows.increase_between(spans.unionByName(whole).select(*keys, "s.*"), series, ["profile_id"]).join(scaled, [*keys])
    shown = F.col("increase") * F.col("scale")
    part = F.least(F.coalesce("most", shown), F.greatest(zero, shown))
    explained = risen.groupBy(*keys).agg(
        F.max(F.when(F.col("what") == "whole", F.round(shown + 1e-9, 4))).alias("noncode_pct"), F.coalesce(F.sum(F.when(F.col("what") != "whole", part)), zero).alias("_explained"),
        F.first("scale").alias("_scale"), F.first("quantum").alias("_quantum"),
    )
    return facts.join(explained, [*keys], "left")


def _projected(steps: DataFrame, states: DataFrame, events: DataFrame, now_us: int) -> DataFrame:
    """By window the projection of its last segment: by recent rates, or by weekday for windows of a week."""
    newest = steps.groupBy(*SERIES).agg(F.max("segment").alias("segment"))
    rates = ordered.recent_rates(steps.join(newest, [*SERIES, "segment"]), now_us, SERIES)
    facts = written(rates.join(states, [*SERIES]), "rates")
    left = F.greatest((F.col("end_us") - now_us) / MINUTE_US, F.lit(0.0))
    to_full = (100 - F.col("last_pct")) / F.col("rate")
    line = facts.where(F.col("width_us") < WEEK_US).select(
        *SERIES, F.round("rate", 6).alias("rate"), F.round(clamp_pct(F.col("last_pct") + F.col("rate") * left), 4).alias("mid_pct"),
        F.round(clamp_pct(F.col("last_pct") + F.least("low", "rate") * left), 4).alias("lo_pct"), F.round(clamp_pct(F.col("last_pct") + F.greatest("high", "rate") * left), 4).alias("hi_pct"),
        F.when((F.col("rate") > 0) & (F.col("last_pct") < 100) & (to_full <= left), F.floor((now_us + to_full * MINUTE_US) / 1000)).alias("eta_ms"),
    )
    # One frame for all long windows: the key of a window is its profile and kind.
    key = F.concat_ws("\u0000", *SERIES).alias("_key")
    long = facts.where(F.col("width_us") >= WEEK_US).select(key, *SERIES, "start_us", "end_us", F.col("pct").alias("last_pct"), "cumulative_pct", "rate", "low", "high")
    since = long.select("_key", "profile_id", (F.col("start_us") - WEIGHT_WEEKS * WEEK_US).alias("_since"))
    history = events.join(since, "profile_id").where((F.col("us") >= F.col("_since")) & (F.col("us") < now_us))
    by_day = calendar.calendar_projection(long, calendar.weekday_weights(history, "_key"), now_us, "_key").join(long.select("_key", *SERIES), "_key")
    return line.unionByName(by_day.select(*line.columns))


def _users(events: DataFrame, bounded: DataFrame, now_us: int) -> DataFrame:
    """By short window: machines, requests and tokens in it, overlap, sessions cut at its ends, and how far the local block is off."""
    short = bounded.where(F.col("width_us") <= SHORT_US)
    span = short.select(*SERIES, (F.col("start_us") - F.col("width_us")).alias("_a"), F.greatest("end_us", F.lit(now_us)).alias("_z"), "start_us", "end_us")
    near = written(events.join(span, "profile_id").where("us >= _a AND us < _z").drop("_a", "_z", "cost_usd", "output_final"), "window-events")
    inside = near.where("us >= start_us AND us < end_us")
    used = inside.groupBy(*SERIES).agg(F.array_join(F.array_sort(F.collect_set("machine_id")), ",").alias("machines"), F.count("*").alias("events"), F.sum("tokens").alias("tokens"))
    overlap = ordered.multi_machine_overlap(inside, SERIES, "start_us", "end_us").drop("start_us")
    sessions = near.groupBy(*SERIES, "session_id").agg(F.min("us").alias("a"), F.max("us").alias("b"), F.first("start_us").alias("s"), F.first("end_us").alias("e"))
    crossed = F.expr("(a < s AND s < b) OR (a < e AND e < b)")
    cut = sessions.groupBy(*SERIES).agg(F.round(F.avg(crossed.cast("int")), 6).alias("cut_rate"))
    key = F.concat_ws("\u0000", *SERIES)
    blocks = ordered.blocks(near.select(key.alias("_key"), "us"), key="_key")
    offset = windows.window_offset(short.select(key.alias("_key"), F.col("end_us").alias("resets_us")), blocks, "_key")
    joined = short.select(*SERIES, key.alias("_key")).join(used, [*SERIES], "left").join(overlap, [*SERIES], "left").join(cut, [*SERIES], "left").join(offset.select("_key", "offset_min"), "_key", "left")
    whole = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(*SERIES, F.coalesce("machines", F.lit("")).alias("machines"), whole("events"), whole("tokens"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"), F.coalesce("cut_rate", F.lit(0.0)).alias("cut_rate"), "offset_min")


def _reference(samples: DataFrame, events: DataFrame, now_us: int) -> DataFrame:
    """(profile_id, reference_usd, reference_windows): the median cost of a full window over recent ended short windows."""
    width = int(5 * HOUR_US)
    named = written(identify_windows(samples.where("window_kind = 'five_hour'")), "named-samples")
    ended = named.where((F.col("window_us") <= now_us) & (F.col("window_us") > now_us - LOOKBACK_US)).select("profile_id", F.col("window_us").alias("end_us"), (F.col("window_us") - width).alias("start_us")).distinct()
    costs = windows.window_costs(ended, named.select("profile_id", "us", "pct", F.col("window_us").alias("resets_us")), events.select("profile_id", "us", "cost_usd", "output_final"))
    return windows.median_of_latest(costs.where("full_usd IS NOT NULL"), ["profile_id"], "end_us", "full_usd").select("profile_id", F.col("usd").alias("reference_usd"), F.col("windows").alias("reference_windows"))


def window_states(samples: DataFrame, events: DataFrame, breakdowns: DataFrame, now_us: int, stale_us: int = STALE_US, drop: float = 2.0) -> DataFrame:
    """One row for each profile and window kind: all that is known of its current window.

    samples(profile_id, window_kind, us, pct, resets_us), events(profile_id, us, machine_id, session_id, tokens,
    cost_usd, output_final) that count toward the quota, breakdowns(profile_id, us, weekly_pct, share_pct,
    week_start_us). Long windows have no users; a window without product shares has no noncode_pct.
    """
    recent = written(samples.where(F.col("us").between(now_us - LOOKBACK_US, now_us)).select(*SERIES, "us", "pct", "resets_us"), "recent-samples")
    since = now_us - (WEIGHT_WEEKS + 1) * WEEK_US - 5 * HOUR_US
    used = written(events.where(F.col("us") >= since).select("profile_id", "us", "machine_id", "session_id", "tokens", "cost_usd", "output_final"), "recent-events")
    latest = latest_windows(recent, now_us)
    own, bounded = own_samples(recent, latest)
    bounded = written(bounded, "current-windows")
    steps = written(_steps(own, used.where(F.col("us") < now_us), drop), "window-steps")

    peaks = steps.groupBy(*SERIES, "segment").agg(F.greatest(F.lit(0.0), F.max("pct")).alias("peak")).groupBy(*SERIES).agg(F.sum("peak").alias("_sum"), F.max("segment").alias("resets"))
    states = bounded.join(peaks, [*SERIES], "left").withColumns({"cumulative_pct": F.round(F.greatest(F.coalesce("_sum", F.lit(0.0)), "pct"), 6), "resets": F.coalesce("resets", F.lit(0))}).drop("_sum")
    states = written(states, "states")
    projected = written(_projected(steps, states, used, now_us), "projections")

    series = windows.noncode_series(breakdowns.where(F.col("us").between(now_us - LOOKBACK_US, now_us)))
    by_kind = lambda kind: recent.where((F.col("window_kind") == kind) & (F.col("us") >= now_us - LOOKBACK_US + 5 * HOUR_US))
    weekly = breakdowns.where(F.col("us").between(now_us - LOOKBACK_US, now_us)).groupBy("profile_id").agg(F.max_by("weekly_pct", "us").alias("weekly_pct"))
    scaled = written(windows.scales(attribution.limit_ratio(by_kind("five_hour"), by_kind("seven_day")), weekly).where("scale IS NOT NULL"), "scales")
    told = written(_attributed(steps, bounded, series, scaled, now_us), "attribution")

    users = _users(used, bounded, now_us)
    reference = _reference(recent, used, now_us).withColumn("window_kind", F.lit("five_hour"))
    joined = states.join(projected, [*SERIES], "left").join(told, [*SERIES], "left").join(users, [*SERIES], "left").join(reference, [*SERIES], "left")
    by_share = (F.col("_scale") == 1) & F.col("noncode_pct").isNotNull()
    beyond = F.when(F.col("_quantum").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.coalesce("_explained", F.lit(0.0)) - F.greatest(F.lit(0.0), "_quantum")))
    within = lambda x: F.greatest(F.lit(0.0), F.least(F.col("cumulative_pct"), x))
    # A week with product shares takes them alone: they cover all of it, and a step of its counter is a whole point.
    other = F.round(F.when(by_share, within(F.col("noncode_pct"))).otherwise(within(F.coalesce("other_lower_pct", F.lit(0.0)) + beyond)), 4)
    usable = F.coalesce(((F.col("_spans") > 0) & (F.col("_far") == 0) & (F.col("unobserved_pct") <= 0)) | by_share, F.lit(False))
    return joined.withColumn("other_pct", other).select(
        *SERIES, window_label().alias("label"), "pct", "captured_us", (F.lit(now_us) - F.col("captured_us") > stale_us).alias("stale"), "resets_us", F.when(F.col("resets_us").isNotNull(), F.col("start_us")).alias("start_us"),
        "cumulative_pct", "resets", "rate", "lo_pct", "mid_pct", "hi_pct", "eta_ms", waste_pct(F.col("pct")).alias("waste_pct"),
        "observed_pct", "other_lower_pct", "ambiguous_pct", "unobserved_pct", "quiet_spans", (F.col("_far") > 0).alias("has_gap"), "noncode_pct", "other_pct", F.round(F.greatest(F.lit(0.0), F.col("cumulative_pct") - F.col("other_pct")), 4).alias("local_pct"), usable.alias("usable"),
        "machines", "events", "tokens", "overlap", "cut_rate", "offset_min", "reference_usd", "reference_windows",
    )
