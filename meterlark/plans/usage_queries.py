"""Registered queries over usage and quota series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.functions.pricing import EXAMPLE, catalog_table, with_cost
from meterlark.functions.scalars import counts_toward_quota, quota_tokens, waste_pct, window_label, window_us
from meterlark.operators import attribution, dedup, ledger, ordered
from meterlark.operators import usage as u
from meterlark.sources import synthetic
from meterlark.sources.shared import written

HOUR_US = ordered.HOUR_US


def priced_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cost(synthetic.usage(spark, sf_dir), catalog_table(spark, EXAMPLE))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.usage(spark, sf_dir).where(counts_toward_quota()).withColumn("tokens", quota_tokens())


def _quota(spark: SparkSession, sf_dir: str, kind: str | None = None, arrival: bool = False) -> DataFrame:
    q = synthetic.quota(spark, sf_dir, arrival)
    return q if kind is None else q.where(F.col("window_kind") == kind)


def _now(spark: SparkSession, sf_dir: str) -> int:
    """The moment a report is made for: the time of the last event, one value."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.unix_micros(F.max("ts").cast("timestamp"))).first()[0] or 0


def _distribution(by: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return u.distribution(priced_usage(spark, sf_dir), by)

    return run


def _series(unit: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return u.distribution_series(priced_usage(spark, sf_dir), "model", unit)

    return run


def usage_hourly(spark, sf_dir):
    return u.usage_hourly(synthetic.usage(spark, sf_dir))


def usage_hourly_view(spark, sf_dir):
    """The hourly rollup with all its sums, cost and what has no price."""
    return u.hourly_view(priced_usage(spark, sf_dir))


def models_seen(spark, sf_dir):
    return u.models_seen(synthetic.usage(spark, sf_dir), 0)


def unpriced_models(spark, sf_dir):
    return u.unpriced_models(u.models_seen(synthetic.usage(spark, sf_dir), 0), catalog_table(spark, EXAMPLE)).select("model", "events", "last_us")


def usage_totals(spark, sf_dir):
    return u.usage_totals(priced_usage(spark, sf_dir))


def share_pct(spark, sf_dir):
    return u.shares(u.distribution(priced_usage(spark, sf_dir), "project")).select("key", "share_pct")


def top_n_rest(spark, sf_dir):
    return u.top_n_rest(u.distribution(priced_usage(spark, sf_dir), "project"), 3)


def heat_grid(spark, sf_dir):
    return u.heat_grid(synthetic.usage(spark, sf_dir))


def cache_trend(spark, sf_dir):
    return u.cache_trend(synthetic.usage(spark, sf_dir))


def attribution_shares(spark, sf_dir):
    return u.attribution_shares(synthetic.usage(spark, sf_dir))


def event_cost(spark, sf_dir):
    return priced_usage(spark, sf_dir).select("event_id", F.round("cost_usd", 6).cast("double").alias("cost_usd"))


def fork_merge(spark, sf_dir):
    s = _tokens(spark, sf_dir).groupBy("session_id", "machine_id", F.coalesce("project", F.lit("(unknown)")).alias("project")).agg(F.min("us").alias("first_us"), F.sum("tokens").alias("total_tokens"))
    named = F.when(~F.col("session_id").endswith("7"), F.concat(F.lit("title "), F.substring("session_id", -1, 1)))
    return u.merge_forks(s.withColumn("title", named))


def treemap_areas(spark, sf_dir):
    return u.treemap_areas(u.distribution(priced_usage(spark, sf_dir), "project"))


def scratch_labels(spark, sf_dir):
    return u.scratch_labels(synthetic.usage(spark, sf_dir))


def dedup_batch(spark, sf_dir):
    d = dedup.dedup_batch(synthetic.usage_feed(spark, sf_dir))
    return d.select("dedup_key", "event_id", "machine_id", "output_tokens", "arrival")


def dedup_upsert(spark, sf_dir):
    d = dedup.dedup_upsert(synthetic.usage_feed(spark, sf_dir))
    return d.select("dedup_key", "event_id", "machine_id", "output_tokens", "copies")


def latest_per_kind(spark, sf_dir):
    q = dedup.latest_by(_quota(spark, sf_dir), ["profile_id", "window_kind"], "us")
    return q.select("profile_id", "window_kind", window_label().alias("label"), "us", "pct", waste_pct(F.col("pct")).alias("waste_pct"), (F.col("resets_us") - window_us()).alias("start_us"))


def active_profile(spark, sf_dir):
    return synthetic.usage(spark, sf_dir).groupBy("profile_id").agg(F.max("us").alias("last_us")).orderBy(F.col("last_us").desc(), "profile_id").limit(1)


def quota_resets_rounded(spark, sf_dir):
    return _quota(spark, sf_dir).select("profile_id", "window_kind", (F.floor(F.col("resets_us") / 600_000_000 + 0.5) * 600).alias("reset_s")).distinct()


def timeline_lanes(spark, sf_dir):
    return ordered.lanes(_tokens(spark, sf_dir))


def lane_overlaps(spark, sf_dir):
    return ordered.lane_overlaps(ordered.lanes(_tokens(spark, sf_dir), 10 * ordered.MINUTE_US))


def gantt_split(spark, sf_dir):
    """Spans of activity cut at the ends of the five-hour windows that the quota samples name."""
    ends = _quota(spark, sf_dir, "five_hour").select(F.col("resets_us").alias("boundary_us")).distinct()
    return ordered.split_at(ordered.lanes(_tokens(spark, sf_dir), 30 * ordered.MINUTE_US), ends)


def usage_blocks(spark, sf_dir):
    return ordered.blocks(_tokens(spark, sf_dir))


def reset_segments(spark, sf_dir):
    return ordered.cumulative_usage(_quota(spark, sf_dir, arrival=True), ties=["event_id"])


def samples_of_window(spark, sf_dir):
    q = _quota(spark, sf_dir)
    last = dedup.latest_by(q, ["profile_id", "window_kind"], "us").select("profile_id", "window_kind", F.col("resets_us").alias("end_us"), (F.col("resets_us") - 2 * window_us()).alias("start_us"))
    return ordered.samples_of_window(q, last).groupBy("profile_id", "window_kind").agg(F.count("*").alias("samples"), F.min("effective_start_us").alias("effective_start_us"), F.min("us").alias("first_us"))


def _newest_segment(q: DataFrame) -> DataFrame:
    last = dedup.latest_by(q, ["profile_id", "window_kind"], "us").select("profile_id", "window_kind", "resets_us")
    current = ordered.reset_segments(q.join(last, ["profile_id", "window_kind", "resets_us"]))
    newest = current.groupBy("profile_id", "window_kind", "resets_us").agg(F.max("segment").alias("segment"))
    return current.join(newest, ["profile_id", "window_kind", "resets_us", "segment"])


def window_projection(spark, sf_dir):
    return ordered.project(_newest_segment(_quota(spark, sf_dir)), _now(spark, sf_dir))


def calendar_projection(spark, sf_dir):
    """The projection of the current seven_day windows by weekday weights of the four weeks before their start and since."""
    from meterlark.operators import calendar

    q, now = _quota(spark, sf_dir, "seven_day"), _now(spark, sf_dir)
    rates = ordered.recent_rates(_newest_segment(q), now)
    state = ordered.cumulative_usage(q).select("profile_id", "resets_us", "cumulative_pct")
    week = synthetic.WINDOW_US["seven_day"]
    windows = rates.join(state, ["profile_id", "resets_us"]).select("profile_id", (F.col("resets_us") - week).alias("start_us"), F.col("resets_us").alias("end_us"), "last_pct", F.greatest("cumulative_pct", "last_pct").alias("cumulative_pct"), "rate", "low", "high")
    since = windows.select("profile_id", (F.col("start_us") - 4 * week).alias("since_us"))
    history = _tokens(spark, sf_dir).join(since, "profile_id").where((F.col("us") >= F.col("since_us")) & (F.col("us") < now))
    return calendar.calendar_projection(windows, calendar.weekday_weights(history), now)


def windows_current(spark, sf_dir):
    """The current state of every window: cumulative use, resets, projection, and what of it came from elsewhere.

    All windows are projected by recent rates, as in the twin; windows_current_full has the long ones by weekday. The
    samples of the current windows, which time bounds, are a table for the three operators that read them.
    """
    keys = ["profile_id", "window_kind"]
    q = _quota(spark, sf_dir)
    # The reset alone: nothing else of the samples has to be computed for it.
    last = q.groupBy(*keys).agg(F.max_by("resets_us", "us").alias("resets_us"))
    current = written(q.join(last, [*keys, "resets_us"]), "current-samples")
    state = ordered.cumulative_usage(current)
    events = _tokens(spark, sf_dir).select("profile_id", "us")
    first = current.groupBy(*keys).agg((F.min("us") - attribution.GAP_US).alias("_from"))
    # Only events that a sample of the window can see.
    near = events.join(first, "profile_id").where("us >= _from").drop("_from")
    quiet = attribution.quiet_attribution(current, near, keys)
    cut = ordered.reset_segments(current)
    newest = cut.groupBy(*keys).agg(F.max("segment").alias("segment"))
    projected = ordered.project(cut.join(newest, [*keys, "segment"]), _now(spark, sf_dir)).select(*keys, "rate", "mid_pct", "lo_pct", "hi_pct", "eta_ms")
    return state.join(projected, keys).join(quiet, keys).select(*keys, window_label().alias("label"), "resets_us", "cumulative_pct", "resets", "rate", "mid_pct", "lo_pct", "hi_pct", "eta_ms", "observed_pct", "other_pct", "ambiguous_pct", "quiet_spans", "gaps")


def multi_machine_overlap(spark, sf_dir):
    day = 24 * HOUR_US
    e = synthetic.usage(spark, sf_dir).withColumn("start_us", F.floor(F.col("us") / day) * day).withColumn("end_us", F.col("start_us") + day)
    return ordered.multi_machine_overlap(e, ["profile_id"], "start_us", "end_us")


def session_cut_rate(spark, sf_dir):
    return ordered.session_cut_rate(synthetic.usage(spark, sf_dir), 5 * HOUR_US)


def window_metrics(spark, sf_dir):
    e = _tokens(spark, sf_dir)
    return e.groupBy("profile_id", (F.floor(F.col("us") / (5 * HOUR_US)) * 5 * HOUR_US).alias("start_us")).agg(F.array_join(F.array_sort(F.collect_set("machine_id")), ",").alias("machines"), F.count("*").alias("events"), F.sum("tokens").alias("tokens"))


def weekday_weights(spark, sf_dir):
    from meterlark.operators.calendar import weekday_weights as weights

    return weights(_tokens(spark, sf_dir))


def calendar_weight(spark, sf_dir):
    from meterlark.operators import calendar

    w = calendar.weekday_weights(_tokens(spark, sf_dir))
    spans = dedup.latest_by(_quota(spark, sf_dir, "seven_day"), ["profile_id"], "us").select("profile_id", F.col("us").alias("from_us"), F.col("resets_us").alias("to_us"))
    return calendar.calendar_weight(spans, w)


def timeline_asof(spark, sf_dir):
    events = _tokens(spark, sf_dir).select("profile_id", "event_id", "us")
    points = _quota(spark, sf_dir, "five_hour").select("profile_id", "us", "pct")
    return ordered.asof_backward(events, points, ["profile_id"], "us", "pct").select("event_id", "profile_id", "pct")


def quiet_attribution(spark, sf_dir):
    return attribution.quiet_attribution(_quota(spark, sf_dir, "five_hour"), _tokens(spark, sf_dir).select("profile_id", "us"))


def calib_observations(spark, sf_dir):
    o = attribution.interval_usage(_quota(spark, sf_dir, "seven_day"), _tokens(spark, sf_dir).select("profile_id", "us", "model", "tokens", "machine_id"))
    return o.select("profile_id", "start_us", "end_us", "delta_pct", "tokens", "single_machine")


def limit_ratio(spark, sf_dir):
    return attribution.limit_ratio(_quota(spark, sf_dir, "five_hour", True), _quota(spark, sf_dir, "seven_day", True), arrival="event_id")


def noncode_increase(spark, sf_dir):
    cut = ordered.reset_segments(_quota(spark, sf_dir, "seven_day"), ["profile_id", "resets_us"])
    flat = cut.withColumn("run", F.concat_ws("-", F.col("resets_us").cast("string"), F.col("segment").cast("string")))
    return attribution.increases(flat, ["profile_id"], "run", "pct").select("profile_id", "us", F.round("increase", 6).alias("increase"))


def isotonic_fit(spark, sf_dir):
    q = _quota(spark, sf_dir, "seven_day").withColumn("noisy", F.col("pct") + (F.col("us") % 7))
    return attribution.isotonic_fit(q.select("profile_id", "resets_us", "us", "noisy"), ["profile_id", "resets_us"], "noisy").select("profile_id", "us", F.round("fitted", 6).alias("fitted"))


def calibration_nnls(spark, sf_dir):
    """The fit of each profile over a feed that one machine for each profile collects, as the operator asks."""
    events = _tokens(spark, sf_dir).select("profile_id", "us", "model", "tokens", F.concat(F.lit("m"), "profile_id").alias("machine_id"))
    return attribution.calibration(attribution.interval_usage(_quota(spark, sf_dir, "seven_day"), events))


def _ledger(spark, sf_dir):
    e = synthetic.usage(spark, sf_dir)
    rows = e.select(
        "event_id", "profile_id", "machine_id", "ts", "us",
        F.expr("CASE model WHEN 'claude-opus-5' THEN 'gpt-a' WHEN 'claude-fable-5-1' THEN 'gpt-b' ELSE 'gpt-unknown' END").alias("model"),
        (F.col("input_tokens") * 10).alias("input_tokens"), (F.col("input_tokens") * 4).alias("cached_tokens"),
        F.when(F.col("event_id") % 5 == 0, F.col("input_tokens")).otherwise(0).alias("cache_write_tokens"),
        "output_tokens", F.floor(F.col("output_tokens") / 2).alias("reasoning_tokens"),
    )
    catalog = spark.createDataFrame([("gpt-a", 10.0, 1.0, 12.5, 50.0, 500, 2.0, 1.5), ("gpt-b", 2.0, 0.2, None, 8.0, None, None, None)], "model string, input double, cached double, cache_write double, output double, long_over long, long_input double, long_output double")
    return ledger.priced(rows, catalog)


def b_usage_model(spark, sf_dir):
    return ledger.usage_coverage(_ledger(spark, sf_dir), [F.col("model").alias("key")])


def b_usage_day(spark, sf_dir):
    return ledger.usage_coverage(_ledger(spark, sf_dir), [F.date_trunc("day", "ts").cast("timestamp_ntz").alias("key")])


def b_coverage(spark, sf_dir):
    return ledger.usage_coverage(_ledger(spark, sf_dir), [F.col("profile_id").alias("key")])


def b_periods(spark, sf_dir):
    return ledger.periods(_quota(spark, sf_dir, arrival=True), ties=["event_id"])


def b_full_cost(spark, sf_dir):
    """Cost of a full window by period: what was spent in it over the share of the quota it used (from 20 points on)."""
    p = ledger.periods(_quota(spark, sf_dir, "five_hour", True), ties=["event_id"]).select("profile_id", "period", "first_us", "last_us", "cumulative_pct")
    spent = ordered.asof_backward(_ledger(spark, sf_dir).select("profile_id", "us", "cost_usd"), p.select("profile_id", F.col("first_us").alias("us"), F.col("period")), ["profile_id"], "us", "period")
    costs = spent.where("period IS NOT NULL").groupBy("profile_id", "period").agg(F.round(F.sum("cost_usd"), 6).cast("double").alias("cost_usd"))
    full = F.when(F.col("cumulative_pct") >= 20, F.round(F.col("cost_usd") / F.col("cumulative_pct") * 100, 4))
    return p.join(costs, ["profile_id", "period"], "left").select("profile_id", "period", "cumulative_pct", "cost_usd", full.alias("full_cost_usd"))


QUERIES = {f"distribution_by_{by}": _distribution(by) for by in ("model", "machine", "project", "hour", "session", "attribution")}
QUERIES |= {f"distribution_series_{unit}": _series(unit) for unit in ("hour", "day")}
QUERIES |= {
    f.__name__: f
    for f in (
        usage_hourly, usage_hourly_view, models_seen, unpriced_models, usage_totals, share_pct, top_n_rest, heat_grid, cache_trend, attribution_shares, event_cost, fork_merge, treemap_areas, scratch_labels,
        dedup_batch, dedup_upsert, latest_per_kind, active_profile, quota_resets_rounded, timeline_lanes, lane_overlaps, gantt_split, usage_blocks, reset_segments, samples_of_window,
        window_projection, calendar_projection, windows_current, multi_machine_overlap, session_cut_rate, window_metrics, weekday_weights, calendar_weight, timeline_asof, quiet_attribution, calib_observations,
        limit_ratio, noncode_increase, isotonic_fit, calibration_nnls, b_usage_model, b_usage_day, b_coverage, b_periods, b_full_cost,
    )
}
# Older names of the same queries, from when the plain ones kept a part of the events.
QUERIES |= {"timeline_asof_all": lambda spark, sf_dir: timeline_asof(spark, sf_dir), "quiet_attribution_all": lambda spark, sf_dir: quiet_attribution(spark, sf_dir)}
for _name, _query in QUERIES.items():
    _query.__name__ = _name
