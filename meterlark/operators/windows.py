"""Quota windows: boundaries, what a window cost, what of it came from other products, curves, and the period reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlark.functions.scalars import clamp_pct
from meterlark.operators import attribution, ordered
from meterlark.operators.ordered import HOUR_US, MINUTE_US, asof_backward
from meterlark.operators.scan import Scan
from meterlark.sources.shared import written

WEEK_US = 168 * HOUR_US
#: Group starts of the same week differ by less than a second between answers; ten minutes tell weeks apart.
ROUND_US = 10 * MINUTE_US
#: How much more a family uses of a weekly limit than its price says (fixed values of the domain).
QUOTA_WEIGHTS = {"seven_day": {"fable": 2.0}}
TAIL_GAP_US, REFERENCE_WINDOWS, LEAST_LOCAL_PCT, SMALL_LOCAL_PCT = 30 * MINUTE_US, 8, 30.0, 20.0


# --- boundaries and ranges ----------------------------------------------------------------------------


def boundaries(ends: DataFrame, from_us: int, to_us: int, width_us: int, end: str = "resets_us") -> DataFrame:
    """ends(keys, end) with every boundary of its window in [from, to], stepping back from the end."""
    steps = F.sequence(F.lit(0), F.floor((F.col(end) - from_us) / width_us))
    keys = [c for c in ends.columns if c != end]
    return ends.where(F.col(end) >= from_us).select(*keys, F.explode(F.transform(steps, lambda k: F.col(end) - k * width_us)).alias("boundary_us")).where(F.col("boundary_us") <= to_us)


def weeks_back(anchors: DataFrame, weeks: int = 8, end: str = "resets_us") -> DataFrame:
    """anchors(keys, end) as `weeks` weeks before it: week (0 the current one), start_us, end_us."""
    keys = [c for c in anchors.columns if c != end]
    each = anchors.select(*keys, end, F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias("week"))
    return each.select(*keys, "week", (F.col(end) - (F.col("week") + 1) * WEEK_US).alias("start_us"), (F.col(end) - F.col("week") * WEEK_US).alias("end_us"))


def in_ranges(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], bucket_us: int, time: str = "us") -> DataFrame:
    """rows joined with the ranges(keys, start_us, end_us, ...) that hold them, an equi-join on time buckets.

    A range is given to each bucket that it touches, so no row meets a range far away.
    """
    cut = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_us") / bucket_us), F.floor((F.col("end_us") - 1) / bucket_us))))
    return rows.withColumn("_b", F.floor(F.col(time) / bucket_us)).join(cut, [*keys, "_b"]).where(f"{time} >= start_us AND {time} < end_us").drop("_b")


def window_offset(windows: DataFrame, blocks: DataFrame, key: str = "profile_id") -> DataFrame:
    """windows(key, resets_us) with the local block that started last before its end, and by how many minutes the official end is later."""
    met = windows.join(blocks.select(key, "start_us", F.col("end_us").alias("local_end_us")), key).where("start_us <= resets_us")
    last = met.groupBy(key, "resets_us").agg(F.max_by("local_end_us", "start_us").alias("local_end_us"))
    return last.withColumn("offset_min", F.round((F.col("resets_us") - F.col("local_end_us")) / MINUTE_US, 6))


# --- other products --------------------------------------------------------------------------------------


def noncode_series(samples: DataFrame, keys: Sequence[str] = ("profile_id",)) -> DataFrame:
    """samples(keys, us, weekly_pct, share_pct, week_start_us) with `value`, points of the week used by other products.

    The share is of the week's use, so it is scaled by it; it cannot fall within a week, so each run between weeks
    and resets is fitted by the closest non-decreasing series (a run is bounded by time, not by rows).
    """
    key = F.floor(F.col("week_start_us") / ROUND_US + 0.5)
    fell = F.col("_p") - F.col("weekly_pct")
    week = F.when(F.col("_k").isNotNull() & F.col("_known").isNotNull(), F.col("_k") != F.col("_known")).otherwise(fell > 0)
    cut = Scan(samples.withColumn("_k", key), keys).last(before=True, _known="_k").runs({"_p": "weekly_pct"}, run=F.col("_p").isNotNull() & (week | (fell >= 2))).frame()
    # A table here: every later step reads the runs more than once.
    points = written(cut.select(*keys, "us", "run", "week_start_us", (F.col("weekly_pct") * F.col("share_pct") / 100).alias("value")), "share-runs")
    fitted = attribution.isotonic_fit(points, [*keys, "run"], "value")
    return fitted.select(*keys, "us", "run", "week_start_us", F.col("fitted").alias("value"))


def increase_between(spans: DataFrame, series: DataFrame, keys: Sequence[str] = ("profile_id",), name: str = "increase") -> DataFrame:
    """spans(keys, from_us, to_us, ...) with the rise of the series in (from, to].

    series(keys, us, run, week_start_us, value): a new run adds its whole value. Before the first point nothing is
    known, but if its week began within the span its own value is an increase too.
    """
    step = F.when(F.col("_pr").isNull(), 0.0).when(F.col("_pr") != F.col("run"), F.col("value")).otherwise(F.col("value") - F.col("_pv"))
    series = written(series.select(*keys, "us", "run", "week_start_us", "value"), "share-series")
    summed = written(Scan(series, keys).lag(_pr="run", _pv="value").running(_sum=step).frame().select(*keys, "us", "_sum"), "share-sums")
    firsts = series.groupBy(*keys).agg(F.min_by("value", "us").alias("_first"), F.min_by("week_start_us", "us").alias("_began"))
    at = spans
    for moment, column in (("from_us", "_a"), ("to_us", "_z")):
        right = summed.select(*keys, F.col("us").alias(moment), F.col("_sum").alias(column))
        at = asof_backward(at, right, keys, moment, column)
    joined = at.join(firsts, list(keys), "left")
    from_start = F.when(F.col("_began") >= F.col("from_us") - ROUND_US, F.col("_first")).otherwise(0.0)
    rise = F.when(F.col("_z").isNull() | (F.col("to_us") <= F.col("from_us")), 0.0).when(F.col("_a").isNotNull(), F.col("_z") - F.col("_a")).otherwise(F.col("_z") + F.coalesce(from_start, F.lit(0.0)))
    return joined.withColumn(name, rise).drop("_a", "_z", "_first", "_began")


def scales(ratios: DataFrame, latest: DataFrame) -> DataFrame:
    """(profile_id, window_kind, scale, quantum): what a point of the week is in points of the window, and one step of the shares.

    ratios(profile_id, ratio), latest(profile_id, weekly_pct). Windows for one model have another base: no scale.
    """
    kinds = F.explode(F.array(F.lit("seven_day"), F.lit("five_hour"))).alias("window_kind")
    each = latest.join(ratios.select("profile_id", "ratio"), "profile_id", "left").select("profile_id", "weekly_pct", "ratio", kinds)
    scale = F.when(F.col("window_kind") == "seven_day", 1.0).otherwise(F.col("ratio"))
    return each.select("profile_id", "window_kind", scale.alias("scale"), F.round(F.col("weekly_pct") / 100 * scale, 6).alias("quantum"))


def usable_attribution(spans: Column, gaps: Column, unobserved: Column) -> Column:
    return (spans > 0) & (gaps == 0) & (unobserved <= 0)


def local_upper_bound(observed: Column, other: Column) -> Column:
    return F.greatest(F.lit(0.0), observed - other)


def fused_other(other: Column, ambiguous_noncode: Column, unobserved_noncode: Column, quantum: Column, used: Column) -> Column:
    """What came from elsewhere: quiet rises, and what the breakdown shows beyond one step of its shares; within what was used."""
    shown = F.when(quantum.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(ambiguous_noncode, F.lit(0.0)) + F.coalesce(unobserved_noncode, F.lit(0.0)) - F.greatest(F.lit(0.0), quantum)))
    return F.greatest(F.lit(0.0), F.least(used, other + shown))


def ambiguous_noncode(samples: DataFrame, events: DataFrame, series: DataFrame, scaled: DataFrame, keys: Sequence[str] = ("profile_id",), lead_us: int = 30 * MINUTE_US, gap_us: int = 30 * MINUTE_US) -> DataFrame:
    """By key the points of rises beside own events that other products explain, at most each rise. scaled(keys, scale)."""
    seen = asof_backward(samples, events.select(*keys, (F.col("us") + 1).alias("us"), F.col("us").alias("_event")).distinct(), keys, "us", "_event")
    pairs = Scan(seen, keys).lag(from_us="us", _from="pct").derive(_rise=F.col("pct") - F.col("_from")).frame()
    up = pairs.where((F.col("us") > F.col("from_us")) & (F.col("us") - F.col("from_us") <= gap_us) & (F.col("_rise") > 0) & (F.col("_event") >= F.col("us") - lead_us))
    risen = increase_between(up.select(*keys, "from_us", F.col("us").alias("to_us"), "_rise"), series, keys).join(F.broadcast(scaled), list(keys))
    part = F.least(F.col("_rise"), F.greatest(F.lit(0.0), F.col("increase") * F.col("scale")))
    return risen.groupBy(*keys).agg(F.round(F.sum(part), 4).alias("noncode_pct"), F.count("*").alias("spans"))


# --- cost of a full window ----------------------------------------------------------------------------------


def median_of_latest(df: DataFrame, keys: Sequence[str], order: str, value: str, most: int = REFERENCE_WINDOWS) -> DataFrame:
    """By key the median of the `most` latest values (two middle ones are averaged) and how many there were."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where(F.col("_r") <= most)
    return ranked.groupBy(*keys).agg(F.round(F.median(value), 4).alias("usd"), F.count("*").alias("windows"))


def window_costs(windows: DataFrame, samples: DataFrame, costed: DataFrame, bucket_us: int = 5 * HOUR_US) -> DataFrame:
    """For each of windows(profile_id, start_us, end_us): what was spent in it, what of its use is local, and the cost of a full one.

    costed(profile_id, us, cost_usd, output_final). full_usd is null where samples end too early or leave gaps, a request
    has no price, nothing was spent, or less than LEAST_LOCAL_PCT points are local.
    """
    keys = ["profile_id", "end_us"]
    windows = written(windows.select("profile_id", "start_us", "end_us"), "cost-windows")
    own = written(in_ranges(samples, windows, ["profile_id"], bucket_us).where(F.abs(F.col("resets_us") - F.col("end_us")) <= ROUND_US).select(*keys, "us", "pct"), "cost-samples")
    inside = written(in_ranges(costed, windows, ["profile_id"], bucket_us).select(*keys, "us", "cost_usd", "output_final"), "cost-events")
    state = ordered.cumulative_usage(own.select(*keys, "us", "pct"), keys).select(*keys, "cumulative_pct", "last_pct")
    ends = own.groupBy(*keys).agg(F.max("us").alias("last_us"))
    quiet = attribution.quiet_attribution(own.select(*keys, "us", "pct"), inside.select(*keys, "us"), keys)
    spent = inside.groupBy(*keys).agg(F.sum("cost_usd").alias("usd"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced"), F.count_if(F.col("output_final") == F.lit(False)).alias("partial"))
    joined = ends.join(state, keys).join(quiet, keys).join(spent, keys, "left")
    used = F.greatest("cumulative_pct", "last_pct")
    local = used - F.least(used, F.col("other_pct"))
    good = (F.col("end_us") - F.col("last_us") <= TAIL_GAP_US) & (F.col("unpriced") == 0) & (F.col("usd") > 0) & (F.col("gaps") == 0) & (local >= LEAST_LOCAL_PCT)
    return joined.select(*keys, F.round(used, 6).alias("used_pct"), F.round(local, 6).alias("local_pct"), F.round("usd", 6).cast("double").alias("usd"), "unpriced", "partial", F.when(good, F.round(F.col("usd").cast("double") / local * 100, 4)).alias("full_usd"))


def family_weighted_cost(buckets: DataFrame, kind: str, keys: Sequence[str]) -> DataFrame:
    """By key the cost of model buckets(keys, key, cost_usd), each family by its weight in this window; null if nothing has a price."""
    from meterlark.functions.presentation import model_in_family

    weight = F.lit(1.0)
    for family, w in QUOTA_WEIGHTS.get(kind, {}).items():
        weight = F.when(model_in_family(F.col("key"), F.lit(family)), w).otherwise(weight)
    return buckets.groupBy(*keys).agg(F.round(F.sum(F.col("cost_usd") * weight), 6).alias("quota_usd"))


def full_cost(quota_usd: Column, local_pct: Column, reference_usd: Column) -> Column:
    """Cost of a full window: from this one, or by reference while little of it is local; null where nothing was spent."""
    own = F.when((quota_usd > 0) & (local_pct > 0), quota_usd / local_pct * 100)
    return F.when(reference_usd.isNotNull() & (local_pct < SMALL_LOCAL_PCT), reference_usd).otherwise(own)


# --- curves -------------------------------------------------------------------------------------------------


def projected_curve(windows: DataFrame, now_us: int, points: int, weights: DataFrame | None = None) -> DataFrame:
    """windows(profile_id, window_kind, resets_us, last_pct, lo, mid, hi) as `points` points from now to the end.

    lo, mid and hi are not clamped: points are interpolated first, so a curve that reaches 100 early does so at the
    right time. The shape is a straight line, or the weekday weights(profile_id, weekday, weight) where given; the last
    point is the projection itself.
    """
    n = max(2, min(points, 2000))
    span = F.col("resets_us") - now_us
    each = windows.where(span > 0).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("us", now_us + F.floor(span * F.col("point") / (n - 1) + 0.5))
    if weights is None:
        shape = (F.col("us") - now_us) / span
    else:
        from meterlark.operators.calendar import DAY_US

        day = F.explode(F.sequence(F.floor(F.lit(now_us) / DAY_US), F.floor((F.col("resets_us") - 1) / DAY_US)))
        keys = ["profile_id", "window_kind", "resets_us"]
        days = windows.where(span > 0).select(*keys, day.alias("day")).withColumn("weekday", ((F.col("day") + 4) % 7).cast("int")).join(weights, ["profile_id", "weekday"], "left").withColumn("_w", F.coalesce("weight", F.lit(1.0)))
        a, z = F.greatest(F.lit(now_us), F.col("day") * DAY_US), F.least(F.col("resets_us"), (F.col("day") + 1) * DAY_US)
        w = Window.partitionBy(*keys)
        part = (z - a) * F.col("_w")
        spread = days.select(*keys, "day", a.alias("_a"), "_w", (F.sum(part).over(w.orderBy("day")) - part).alias("_before"), F.sum(part).over(w).alias("_all"))
        each = each.withColumn("day", F.floor(F.least(F.col("us"), F.col("resets_us") - 1) / DAY_US)).join(spread, [*keys, "day"])
        shape = (F.col("_before") + (F.col("us") - F.col("_a")) * F.col("_w")) / F.col("_all")
    s = F.when(F.col("point") == n - 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), shape)))
    value = lambda c: F.round(clamp_pct(F.col("last_pct") + (F.col(c) - F.col("last_pct")) * s), 4).alias(c)
    return each.select("profile_id", "window_kind", "point", "us", value("lo"), value("mid"), value("hi"))


def burn_curve(samples: DataFrame, keys: Sequence[str], most: int = 240) -> DataFrame:
    """At most `most` points of each window, ends included, with the number of resets before each."""
    return ordered.downsample(ordered.reset_segments(samples, keys), keys, "us", most).select(*keys, "us", "pct", "segment")


def broken_curve(points: DataFrame, keys: Sequence[str], drop: float = 2.0) -> DataFrame:
    """points(keys, us, pct) with an empty point just before each reset, so that a drawn line breaks there."""
    marked = Scan(points, keys).lag(_p="pct").derive(_fell=F.coalesce(F.col("_p") - F.col("pct") >= drop, F.lit(False))).frame()
    gap = F.array(F.struct((F.col("us") - 1000).alias("us"), F.lit(None).cast("double").alias("pct")), F.struct("us", "pct"))
    return marked.select(*keys, F.explode(F.when(F.col("_fell"), gap).otherwise(F.slice(gap, 2, 1))).alias("_p")).select(*keys, "_p.us", "_p.pct")


def split_by_source(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """points(keys, us, pct, interpolated) as two series: official ones, and interpolated runs with one point more at both ends."""
    near = F.col("interpolated") | F.coalesce("_before", F.lit(False)) | F.coalesce("_after", F.lit(False))
    return Scan(points, keys).lag(_before="interpolated").lead(_after="interpolated").frame().select(*keys, "us", F.when(~F.col("interpolated"), F.col("pct")).alias("official"), F.when(near, F.col("pct")).alias("estimated"))


def calibration_points(observed: DataFrame, weights: DataFrame, keys: Sequence[str] = ("profile_id",), most: int = 1000) -> DataFrame:
    """Each single-machine observation as weighted tokens, its rise and the fitted one, with the residual band. weights(keys, model, weight, limit_tokens, residual)."""
    clean = observed.where("single_machine AND delta_pct > 0")
    parts = clean.select(*keys, "start_us", "delta_pct", F.explode("tokens_by_model").alias("model", "tokens")).join(F.broadcast(weights), [*keys, "model"], "left")
    limits = weights.groupBy(*keys).agg(F.max("limit_tokens").alias("_limit"), F.max("residual").alias("_res"))
    each = parts.groupBy(*keys, "start_us", "delta_pct").agg(F.sum(F.coalesce(F.col("weight") * F.col("tokens"), F.lit(0.0))).alias("weighted_tokens")).join(F.broadcast(limits), list(keys))
    fitted, band = F.when(F.col("_limit") > 0, F.col("weighted_tokens") / F.col("_limit") * 100).otherwise(0.0), F.greatest(F.lit(0.0), F.least(F.lit(0.9), F.col("_res")))
    full = each.select(*keys, "start_us", "delta_pct", F.round("weighted_tokens", 4).alias("weighted_tokens"), F.round(fitted, 6).alias("fitted_pct"), F.round(fitted * (1 - band), 6).alias("low_pct"), F.round(fitted * (1 + band), 6).alias("high_pct"))
    return ordered.downsample(full, keys, "start_us", most)


def summary(states: DataFrame, now_us: int, stale_us: int = 15 * MINUTE_US) -> DataFrame:
    """One row for each profile: what a tray shows. states(profile_id, window_kind, pct, us, eta_ms, rate).

    The window that runs out first, else the shortest one; data are as old as the oldest window's.
    """
    from meterlark.functions.presentation import tray_text
    from meterlark.functions.scalars import window_us

    place = F.struct(window_us(), F.col("window_kind"))
    soon = F.col("eta_ms").isNotNull()
    primary = F.struct(F.when(soon, 0).otherwise(1), F.when(soon, F.col("eta_ms")), place)
    one = states.groupBy("profile_id").agg(
        F.min_by(F.struct("window_kind", "pct", "rate"), primary).alias("p"), F.min_by("window_kind", F.when(soon, F.struct("eta_ms", place))).alias("soonest_kind"), F.min("eta_ms").alias("soonest_eta_ms"), F.min("us").alias("captured_us"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(window_us().alias("w"), "window_kind"))), lambda x: x["window_kind"]), ",").alias("kinds"),
    )
    return one.select("profile_id", tray_text(F.col("p.pct")).alias("tray"), F.col("p.window_kind").alias("primary_kind"), F.col("p.rate").alias("rate"), "soonest_kind", "soonest_eta_ms", "captured_us", (F.lit(now_us) - F.col("captured_us") > stale_us).alias("stale"), "kinds")


# --- the second ledger ------------------------------------------------------------------------------------


def lookback_us(longest_minutes: int | None) -> int:
    """How far a report of current periods looks back: three of the longest windows, within bounds."""
    minutes = 7 * 1440 if longest_minutes is None else longest_minutes
    day = 24 * HOUR_US
    return min(29 * day, max(minutes * MINUTE_US * 3, 2 * day) + day)


def period_starts(periods: DataFrame, minutes: Column) -> DataFrame:
    """periods with starts_us: the reset that opened it, else its deadline less its length, else its first sample."""
    scheduled = F.when(minutes.isNotNull(), F.col("resets_us") - minutes * MINUTE_US)
    return periods.withColumn("starts_us", F.when(F.col("opened_by_reset"), F.col("first_us")).otherwise(F.coalesce(scheduled, F.col("first_us"))))


def listed_periods(periods: DataFrame, now_us: int, weeks: int = 4) -> DataFrame:
    """Periods that end within the last weeks, newest first by position."""
    cutoff = now_us - weeks * WEEK_US
    kept = periods.where(F.greatest("resets_us", "last_us") >= cutoff)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("profile_id", "window_kind").orderBy(F.col("first_us").desc())))


def period_analysis(history: DataFrame, now_us: int, keys: Sequence[str] = ("profile_id", "window_kind")) -> DataFrame:
    """Projection of each current period from its last segment alone; a period that is over stays where it is."""
    last = history.groupBy(*keys).agg(F.max_by("resets_us", "us").alias("resets_us"))
    current = ordered.reset_segments(history.join(F.broadcast(last), [*keys, "resets_us"]), [*keys, "resets_us"])
    newest = current.groupBy(*keys).agg(F.max("segment").alias("segment"))
    projected = ordered.project(current.join(F.broadcast(newest), [*keys, "segment"]), now_us, [*keys, "resets_us"])
    over = F.col("resets_us") <= now_us
    flat = lambda c: F.when(over, F.col("last_pct")).otherwise(F.col(c)).alias(c)
    return projected.select(*keys, "resets_us", "last_pct", F.when(over, 0.0).otherwise(F.col("rate")).alias("rate"), flat("lo_pct"), flat("mid_pct"), flat("hi_pct"), F.when(~over, F.col("eta_ms")).alias("eta_ms"))


def full_cost_estimate(cost: Column, cumulative: Column, unpriced: Column, reference: Column) -> Column:
    """(usd, basis, lower_bound): from the current period once it is large enough, else from past ones."""
    own = F.when((cost > 0) & (cumulative > 0), cost / cumulative * 100)
    by_reference = reference.isNotNull() & ((cumulative < SMALL_LOCAL_PCT) | own.isNull())
    as_struct = lambda usd, basis, bound: F.struct(F.round(usd, 4).alias("usd"), F.lit(basis).alias("basis"), bound.alias("lower_bound"))
    return F.when(by_reference, as_struct(reference, "reference", F.lit(False))).when(own.isNotNull(), as_struct(own, "current", unpriced > 0))
