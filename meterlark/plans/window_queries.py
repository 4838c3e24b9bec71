"""Registered queries of the window operators, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meterlark.functions.scalars import window_us
from meterlark.operators import attribution, calendar, dedup, ledger, ordered, windows
from meterlark.operators import usage as u
from meterlark.plans import usage_queries as uq
from meterlark.plans.oracles import _DAYS, _LATEST, _LEDGER, _PERIODS, _PROJECTION, _SEGMENTS, PRICED_SQL, _quiet
from meterlark.sources import synthetic
from meterlark.sources.synthetic import QUOTA_SQL

QUERIES, ORACLES = {}, {}
WEEK, FIVE, DAY = 604_800_000_000, 18_000_000_000, 86_400_000_000


def _add(name: str, query, sql: str | None = None) -> None:
    query.__name__ = name
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _latest(spark, sf, kind=None):
    return dedup.latest_by(uq._quota(spark, sf, kind), ["profile_id", "window_kind"], "us")


def _boundaries(spark, sf):
    last = _latest(spark, sf, "five_hour").select("profile_id", "resets_us")
    now = uq._now(spark, sf)
    return windows.boundaries(last, now - WEEK, now, FIVE)


_NOW = "now AS (SELECT max(epoch_us(ts)) AS n FROM events)"
_add(
    "window_boundaries",
    _boundaries,
    f"""WITH {QUOTA_SQL}, {_LATEST}, {_NOW}, b AS (SELECT profile_id, unnest([resets_us - k * {FIVE} FOR k IN range(0, (resets_us - (n - {WEEK})) // {FIVE} + 1)]) AS boundary_us, n FROM latest, now WHERE window_kind = 'five_hour')
SELECT profile_id, boundary_us FROM b WHERE boundary_us <= n""",
)


def _weeks(spark, sf):
    """Eight weeks of each profile: tokens and cost of its requests, points used, and what a full week would cost."""
    weeks = windows.weeks_back(_latest(spark, sf, "seven_day").select("profile_id", "resets_us"))
    costed = uq.priced_usage(spark, sf).where(u.counts_toward_quota()).select("profile_id", "us", u.quota_tokens().alias("tokens"), "cost_usd")
    spent = windows.in_ranges(costed, weeks, ["profile_id"], WEEK).groupBy("profile_id", "week").agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost_usd"), 6).cast("double").alias("cost_usd"))
    used = ordered.cumulative_usage(uq._quota(spark, sf, "seven_day", True), ties=["event_id"]).select("profile_id", F.col("resets_us").alias("end_us"), "cumulative_pct")
    joined = weeks.join(spent, ["profile_id", "week"], "left").join(used, ["profile_id", "end_us"], "left")
    return joined.select("profile_id", "week", "start_us", "end_us", "tokens", "cost_usd", "cumulative_pct", F.when(F.col("cumulative_pct") >= 5, F.round(F.col("cost_usd") / F.col("cumulative_pct") * 100, 4)).alias("full_usd"))


_add(
    "weeks_back",
    _weeks,
    f"""WITH {PRICED_SQL}, {_SEGMENTS}, {_LATEST}, w AS (SELECT profile_id, CAST(k AS INTEGER) AS week, resets_us - (k + 1) * {WEEK} AS start_us, resets_us - k * {WEEK} AS end_us FROM latest, range(0, 8) r(k) WHERE window_kind = 'seven_day'),
s AS (SELECT w.profile_id, w.week, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(round(sum(cost_usd), 6) AS DOUBLE) AS cost_usd FROM w JOIN counted c ON c.profile_id = w.profile_id AND c.us >= start_us AND c.us < end_us GROUP BY 1, 2)
SELECT w.profile_id, w.week, start_us, end_us, tokens, cost_usd, cumulative_pct, CASE WHEN cumulative_pct >= 5 THEN round(cost_usd / cumulative_pct * 100, 4) END AS full_usd
FROM w LEFT JOIN s USING (profile_id, week) LEFT JOIN (SELECT profile_id, resets_us AS end_us, cumulative_pct FROM state WHERE window_kind = 'seven_day') t USING (profile_id, end_us)""",
)
_BLOCKS = f"""hours AS (SELECT profile_id, us // 3600000000 AS hour FROM counted GROUP BY ALL), starts AS (
  SELECT profile_id, min(hour) AS hour FROM hours GROUP BY 1
  UNION ALL SELECT s.profile_id, (SELECT min(h.hour) FROM hours h WHERE h.profile_id = s.profile_id AND h.hour >= s.hour + 5) FROM starts s WHERE s.hour IS NOT NULL
), blocks AS (SELECT profile_id, hour * 3600000000 AS start_us, (hour + 5) * 3600000000 AS local_end_us FROM starts WHERE hour IS NOT NULL)"""
_add(
    "window_offset",
    lambda spark, sf: windows.window_offset(_latest(spark, sf, "five_hour").select("profile_id", "resets_us"), ordered.blocks(uq._tokens(spark, sf))),
    f"""WITH RECURSIVE {PRICED_SQL}, {_BLOCKS}, {QUOTA_SQL}, {_LATEST} SELECT l.profile_id, l.resets_us, arg_max(local_end_us, start_us) AS local_end_us, round((l.resets_us - arg_max(local_end_us, start_us)) / 6e7, 6) AS offset_min
FROM latest l JOIN blocks b ON b.profile_id = l.profile_id AND b.start_us <= l.resets_us WHERE window_kind = 'five_hour' GROUP BY 1, 2""",
)


def _breakdowns(spark, sf):
    """Samples of the product breakdown: the week's points, and a share of other products that rises and falls a little."""
    q = uq._quota(spark, sf, "seven_day")
    share = F.floor(F.col("us") / 1_000_000) % 30
    return q.select("profile_id", "us", F.col("pct").alias("weekly_pct"), share.cast("double").alias("share_pct"), (F.col("resets_us") - WEEK + F.col("us") % 1000).alias("week_start_us"))


_NONCODE = f"""bd AS (
  SELECT profile_id, us, pct AS weekly_pct, (us // 1000000) % 30 AS share_pct, resets_us - {WEEK} + us % 1000 AS week_start_us, lag(pct) OVER w AS pp, lag(resets_us) OVER w AS pr, resets_us FROM quota WHERE window_kind = 'seven_day' WINDOW w AS (PARTITION BY profile_id ORDER BY us)
), rn AS (
  SELECT *, CAST(sum(CASE WHEN pp IS NOT NULL AND (pr <> resets_us OR pp - weekly_pct >= 2) THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run, weekly_pct * share_pct / 100 AS y FROM bd
), ix AS (
  SELECT *, row_number() OVER w AS i, sum(y) OVER (PARTITION BY profile_id, run ORDER BY us ROWS UNBOUNDED PRECEDING) AS c FROM rn WINDOW w AS (PARTITION BY profile_id, run ORDER BY us)
), sp AS (
  SELECT a.profile_id, a.run, a.i AS a, z.i AS z, (z.c - a.c + a.y) / (z.i - a.i + 1) AS m FROM ix a JOIN ix z ON a.profile_id = z.profile_id AND a.run = z.run AND z.i >= a.i
), lo AS (
  SELECT profile_id, run, a, z, min(m) OVER (PARTITION BY profile_id, run, a ORDER BY z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least FROM sp
), ft AS (
  SELECT profile_id, run, z AS i, max(least) AS value FROM lo GROUP BY 1, 2, 3
), series AS (SELECT x.profile_id, x.us, x.run, x.week_start_us, f.value FROM ix x JOIN ft f USING (profile_id, run, i)),
summed AS (
  SELECT *, sum(CASE WHEN lag_run IS NULL THEN 0 WHEN lag_run <> run THEN value ELSE value - lag_value END) OVER (PARTITION BY profile_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT *, lag(run) OVER w AS lag_run, lag(value) OVER w AS lag_value FROM series WINDOW w AS (PARTITION BY profile_id ORDER BY us))
), firsts AS (SELECT profile_id, arg_min(value, us) AS first, arg_min(week_start_us, us) AS began FROM series GROUP BY 1)"""


def _series(spark, sf):
    return windows.noncode_series(_breakdowns(spark, sf))


_add("noncode_series", lambda spark, sf: _series(spark, sf).select("profile_id", "us", "run", F.round("value", 6).alias("value")), f"WITH {QUOTA_SQL}, {_NONCODE} SELECT profile_id, us, run, round(value, 6) AS value FROM series")


def _day_rises(spark, sf):
    """The rise of other products' points in each day since the first."""
    days = uq._quota(spark, sf, "seven_day").select("profile_id", (F.floor(F.col("us") / DAY) * DAY).alias("from_us")).distinct().withColumn("to_us", F.col("from_us") + DAY)
    return windows.increase_between(days, _series(spark, sf)).select("profile_id", "from_us", F.round(F.col("increase") + 1e-9, 4).alias("increase"))


_RISE = """CASE WHEN z.s IS NULL THEN 0 WHEN a.s IS NOT NULL THEN z.s - a.s ELSE z.s + CASE WHEN f.began >= d.from_us - 600000000 THEN f.first ELSE 0 END END"""
_add(
    "noncode_increase_days",
    _day_rises,
    f"""WITH {QUOTA_SQL}, {_NONCODE}, d AS (SELECT DISTINCT profile_id, us // {DAY} * {DAY} AS from_us, us // {DAY} * {DAY} + {DAY} AS to_us FROM quota WHERE window_kind = 'seven_day')
SELECT d.profile_id, d.from_us, round({_RISE} + 1e-9, 4) AS increase FROM d ASOF LEFT JOIN summed a ON a.profile_id = d.profile_id AND d.from_us >= a.us ASOF LEFT JOIN summed z ON z.profile_id = d.profile_id AND d.to_us >= z.us LEFT JOIN firsts f ON f.profile_id = d.profile_id""",
)


def _scales(spark, sf):
    ratios = attribution.limit_ratio(uq._quota(spark, sf, "five_hour", True), uq._quota(spark, sf, "seven_day", True), arrival="event_id")
    return windows.scales(ratios, _latest(spark, sf, "seven_day").select("profile_id", F.col("pct").alias("weekly_pct")))


_RATIO = """lr_p AS (SELECT a.profile_id, a.us, a.pct AS s, b.pct AS l FROM quota a JOIN quota b ON a.profile_id = b.profile_id AND a.us = b.us AND a.window_kind = 'five_hour' AND b.window_kind = 'seven_day'),
lr_g AS (SELECT *, lag(s) OVER w AS ps, lag(l) OVER w AS pl, lag(us) OVER w AS pu FROM lr_p WINDOW w AS (PARTITION BY profile_id ORDER BY us)),
lr_c AS (SELECT *, sum(CASE WHEN s < ps OR l < pl OR us - pu > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM lr_g),
lr_e AS (SELECT profile_id, k, arg_max(s, us) - arg_min(s, us) AS ds, arg_max(l, us) - arg_min(l, us) AS dl FROM lr_c GROUP BY 1, 2),
ratio AS (SELECT profile_id, CASE WHEN sum(dl) >= 5 AND sum(ds) > 0 THEN round(sum(dl) / sum(ds), 6) END AS ratio FROM lr_e GROUP BY 1),
scales AS (SELECT l.profile_id, k.kind AS window_kind, CASE k.kind WHEN 'seven_day' THEN 1 ELSE ratio END AS scale, round(l.pct / 100 * CASE k.kind WHEN 'seven_day' THEN 1 ELSE ratio END, 6) AS quantum
  FROM latest l LEFT JOIN ratio USING (profile_id), (VALUES ('seven_day'), ('five_hour')) k(kind) WHERE l.window_kind = 'seven_day')"""
_add("noncode_scales", _scales, f"WITH {QUOTA_SQL}, {_LATEST}, {_RATIO} SELECT profile_id, window_kind, CAST(scale AS DOUBLE) AS scale, quantum FROM scales")


def _fused(spark, sf):
    """What of each profile's weekly rises came from elsewhere: quiet spans and other products together."""
    q, events = uq._quota(spark, sf, "seven_day"), uq._tokens(spark, sf).select("profile_id", "us")
    quiet = attribution.quiet_attribution(q, events)
    scaled = _scales(spark, sf).where("window_kind = 'seven_day'").select("profile_id", "scale", "quantum")
    shown = windows.ambiguous_noncode(q, events, _series(spark, sf), scaled.select("profile_id", "scale"))
    joined = quiet.join(shown, "profile_id", "left").join(scaled, "profile_id")
    fused = windows.fused_other(F.col("other_pct"), F.col("noncode_pct"), F.lit(None).cast("double"), F.col("quantum"), F.col("observed_pct"))
    return joined.select("profile_id", "observed_pct", "other_pct", "noncode_pct", F.round(windows.local_upper_bound(F.col("observed_pct"), F.col("other_pct")), 6).alias("local_pct"), F.round(fused, 4).alias("fused_pct"), windows.usable_attribution(F.col("quiet_spans"), F.col("gaps"), F.col("unobserved_pct")).alias("usable"))


_add(
    "fused_attribution",
    _fused,
    f"""WITH {PRICED_SQL}, {QUOTA_SQL}, {_LATEST}, {_RATIO}, {_NONCODE}, {_quiet("SELECT profile_id, us, pct FROM quota WHERE window_kind = 'seven_day'", "SELECT profile_id, us FROM counted", "profile_id")},
d AS (SELECT profile_id, pu AS from_us, us AS to_us, rise FROM marked WHERE up AND busy AND us > pu),
r AS (SELECT d.profile_id, d.rise, {_RISE} AS inc FROM d ASOF LEFT JOIN summed a ON a.profile_id = d.profile_id AND d.from_us >= a.us ASOF LEFT JOIN summed z ON z.profile_id = d.profile_id AND d.to_us >= z.us LEFT JOIN firsts f ON f.profile_id = d.profile_id),
nc AS (SELECT profile_id, round(sum(least(rise, greatest(0, inc))), 4) AS noncode_pct FROM r GROUP BY 1)
SELECT q.profile_id, observed_pct, other_pct, noncode_pct, round(greatest(0, observed_pct - other_pct), 6) AS local_pct,
  round(greatest(0, least(observed_pct, other_pct + greatest(0, coalesce(noncode_pct, 0) - greatest(0, quantum)))), 4) AS fused_pct, quiet_spans > 0 AND gaps = 0 AND unobserved_pct <= 0 AS usable
FROM quiet q LEFT JOIN nc USING (profile_id) JOIN scales s ON s.profile_id = q.profile_id AND s.window_kind = 'seven_day'""",
)


def _window_costs(spark, sf):
    now = uq._now(spark, sf)
    q = uq._quota(spark, sf, "five_hour")
    ends = q.where(F.col("resets_us") <= now).select("profile_id", F.col("resets_us").alias("end_us"), (F.col("resets_us") - FIVE).alias("start_us")).distinct()
    return windows.window_costs(ends, q, uq.priced_usage(spark, sf).where(u.counts_toward_quota()).select("profile_id", "us", "cost_usd", "output_final"))


_COSTS = f"""own AS (SELECT profile_id, resets_us AS end_us, us, pct FROM quota, now WHERE window_kind = 'five_hour' AND resets_us <= n),
iev AS (SELECT profile_id, us // {FIVE} * {FIVE} + {FIVE} AS end_us, us, cost_usd, output_final FROM counted),
spent AS (SELECT profile_id, end_us, sum(cost_usd) AS usd, count(*) FILTER (cost_usd IS NULL) AS unpriced, count(*) FILTER (output_final = false) AS partial FROM iev GROUP BY 1, 2),
lasts AS (SELECT profile_id, end_us, max(us) AS last_us FROM own GROUP BY 1, 2),
{_quiet("SELECT * FROM own", "SELECT profile_id, end_us, us FROM iev", "profile_id, end_us")},
wc AS (
  SELECT profile_id, end_us, greatest(cumulative_pct, last_pct) AS used, greatest(cumulative_pct, last_pct) - least(greatest(cumulative_pct, last_pct), other_pct) AS local, usd, unpriced, partial, gaps, last_us
  FROM lasts JOIN (SELECT profile_id, resets_us AS end_us, cumulative_pct, last_pct FROM state WHERE window_kind = 'five_hour') USING (profile_id, end_us) JOIN quiet USING (profile_id, end_us) LEFT JOIN spent USING (profile_id, end_us)
), costs AS (
  SELECT profile_id, end_us, round(used, 6) AS used_pct, round(local, 6) AS local_pct, CAST(round(usd, 6) AS DOUBLE) AS usd, unpriced, partial,
    CASE WHEN end_us - last_us <= 1800000000 AND unpriced = 0 AND usd > 0 AND gaps = 0 AND local >= 30 THEN round(CAST(usd AS DOUBLE) / local * 100, 4) END AS full_usd FROM wc
)"""
_add("window_costs", _window_costs, f"WITH {PRICED_SQL}, {_SEGMENTS}, {_NOW}, {_COSTS} SELECT * FROM costs")
_add(
    "full_cost_reference",
    lambda spark, sf: windows.median_of_latest(_window_costs(spark, sf).where("used_pct > 0 AND usd > 0").withColumn("each", F.col("usd") / F.col("used_pct") * 100), ["profile_id"], "end_us", "each"),
    f"""WITH {PRICED_SQL}, {_SEGMENTS}, {_NOW}, {_COSTS}, r AS (SELECT profile_id, usd / used_pct * 100 AS each FROM costs WHERE used_pct > 0 AND usd > 0 QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY end_us DESC) <= 8)
SELECT profile_id, round(median(each), 4) AS usd, count(*) AS windows FROM r GROUP BY 1""",
)


def _quota_cost(spark, sf):
    by_model = uq.priced_usage(spark, sf).where(u.counts_toward_quota()).groupBy("profile_id", F.col("model").alias("key")).agg(F.sum("cost_usd").cast("double").alias("cost_usd"))
    weighted = windows.family_weighted_cost(by_model, "seven_day", ["profile_id"])
    used = _latest(spark, sf, "seven_day").select("profile_id", "pct")
    return weighted.join(used, "profile_id").select("profile_id", F.round(F.col("quota_usd") + 1e-9, 4).alias("quota_usd"), F.round(windows.full_cost(F.col("quota_usd"), F.col("pct"), F.lit(90.0)), 4).alias("full_usd"))


_add(
    "quota_weighted_cost",
    _quota_cost,
    f"""WITH {PRICED_SQL}, {QUOTA_SQL}, {_LATEST}, m AS (SELECT profile_id, model, CAST(sum(cost_usd) AS DOUBLE) AS c FROM counted GROUP BY 1, 2), w AS (SELECT profile_id, round(sum(c * CASE WHEN model LIKE 'claude-fable-%' THEN 2 ELSE 1 END), 6) AS q FROM m GROUP BY 1)
SELECT profile_id, round(q + 1e-9, 4) AS quota_usd, round(CASE WHEN pct < 20 THEN 90 WHEN q > 0 AND pct > 0 THEN q / pct * 100 END, 4) AS full_usd FROM w JOIN latest USING (profile_id) WHERE window_kind = 'seven_day'""",
)


def _ends(spark, sf, kind):
    """The current windows of a kind with their projected ends, not clamped."""
    now = uq._now(spark, sf)
    rates = ordered.recent_rates(uq._newest_segment(uq._quota(spark, sf, kind)), now)
    left = F.greatest((F.col("resets_us") - now) / ordered.MINUTE_US, F.lit(0.0))
    at = lambda rate, name: (F.col("last_pct") + rate * left).alias(name)
    return rates.select("profile_id", "window_kind", "resets_us", "last_pct", at(F.least("low", "rate"), "lo"), at(F.col("rate"), "mid"), at(F.greatest("high", "rate"), "hi")), now


def _line(spark, sf):
    ends, now = _ends(spark, sf, "five_hour")
    return windows.projected_curve(ends, now, 25)


def _calendar_curve(spark, sf):
    ends, now = _ends(spark, sf, "seven_day")
    return windows.projected_curve(ends, now, 25, calendar.weekday_weights(uq._tokens(spark, sf)))


_CURVE = f"""ends AS (
  SELECT d.profile_id, d.window_kind, d.resets_us, last_pct, n, last_pct + least(low, rate) * greatest((resets_us - n) / 6e7, 0) AS lo, last_pct + rate * greatest((resets_us - n) / 6e7, 0) AS mid, last_pct + greatest(high, rate) * greatest((resets_us - n) / 6e7, 0) AS hi FROM done d, now WHERE resets_us > n
), pts AS (SELECT e.*, CAST(p AS INTEGER) AS point, n + CAST(floor((resets_us - n) * p / 24 + 0.5) AS BIGINT) AS us FROM ends e, range(0, 25) r(p))"""
_SHAPED = "round(least(100, greatest(0, last_pct + ({0} - last_pct) * s)), 4) AS {0}"
_POINTS = ", ".join(_SHAPED.format(c) for c in ("lo", "mid", "hi"))
_add("projected_curve", _line, f"WITH {_PROJECTION}, {_CURVE} SELECT profile_id, window_kind, point, us, {_POINTS} FROM (SELECT *, CASE WHEN point = 24 THEN 1 ELSE least(1, greatest(0, (us - n) / (resets_us - n))) END AS s FROM pts WHERE window_kind = 'five_hour')")
_add(
    "projected_curve_calendar",
    _calendar_curve,
    f"""WITH {_DAYS}, {_PROJECTION}, {_CURVE}, dd AS (SELECT profile_id, resets_us, n, unnest(range(n // {DAY}, (resets_us - 1) // {DAY} + 1)) AS day FROM ends WHERE window_kind = 'seven_day'),
dw AS (SELECT d.profile_id, d.day, greatest(n, day * {DAY}) AS a, coalesce(w.weight, 1) AS w, (least(resets_us, (day + 1) * {DAY}) - greatest(n, day * {DAY})) * coalesce(w.weight, 1) AS part FROM dd d LEFT JOIN weights w ON w.profile_id = d.profile_id AND w.weekday = (day + 4) % 7),
sp AS (SELECT *, sum(part) OVER (PARTITION BY profile_id ORDER BY day) - part AS before, sum(part) OVER (PARTITION BY profile_id) AS al FROM dw)
SELECT p.profile_id, window_kind, point, us, {_POINTS} FROM (SELECT p.*, CASE WHEN point = 24 THEN 1 ELSE least(1, greatest(0, (before + (us - a) * w) / al)) END AS s FROM pts p JOIN sp ON sp.profile_id = p.profile_id AND sp.day = least(us, resets_us - 1) // {DAY} WHERE window_kind = 'seven_day') p""",
)


def _current(spark, sf):
    q = uq._quota(spark, sf)
    return q.join(F.broadcast(_latest(spark, sf).select("profile_id", "window_kind", "resets_us")), ["profile_id", "window_kind", "resets_us"])


_add(
    "burn_curve",
    lambda spark, sf: windows.burn_curve(_current(spark, sf), ["profile_id", "window_kind", "resets_us"], 50),
    f"""WITH {_SEGMENTS}, {_LATEST}, c AS (SELECT s.*, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY s.profile_id, s.window_kind) AS m FROM seg s JOIN latest l USING (profile_id, window_kind, resets_us) WINDOW w AS (PARTITION BY s.profile_id, s.window_kind ORDER BY s.us))
SELECT profile_id, window_kind, resets_us, us, pct, segment FROM c WHERE m <= 50 OR i IN (SELECT CAST(floor(k * (m - 1) / 49 + 0.5) AS BIGINT) FROM range(0, 50) r(k))""",
)
_add(
    "weekly_curve",
    lambda spark, sf: windows.broken_curve(uq._quota(spark, sf, "seven_day").select("profile_id", "us", "pct"), ["profile_id"]),
    f"""WITH {QUOTA_SQL}, l AS (SELECT profile_id, us, pct, lag(pct) OVER (PARTITION BY profile_id ORDER BY us) AS p FROM quota WHERE window_kind = 'seven_day')
SELECT profile_id, us, pct FROM l UNION ALL SELECT profile_id, us - 1000, NULL FROM l WHERE p - pct >= 2""",
)
_add(
    "curve_by_source",
    lambda spark, sf: windows.split_by_source(uq._quota(spark, sf, "five_hour").select("profile_id", "us", "pct", (F.floor(F.col("us") / 1_000_000) % 4 == 0).alias("interpolated")), ["profile_id"]),
    f"""WITH {QUOTA_SQL}, p AS (SELECT profile_id, us, pct, (us // 1000000) % 4 = 0 AS x FROM quota WHERE window_kind = 'five_hour')
SELECT profile_id, us, CASE WHEN NOT x THEN pct END AS official, CASE WHEN x OR coalesce(lag(x) OVER w, false) OR coalesce(lead(x) OVER w, false) THEN pct END AS estimated FROM p WINDOW w AS (PARTITION BY profile_id ORDER BY us)""",
)


def _fit_points(spark, sf):
    """Observations of one machine at a time against a fixed fit."""
    o = attribution.interval_usage(uq._quota(spark, sf, "seven_day"), uq._tokens(spark, sf).select("profile_id", "us", "model", "tokens", "machine_id"))
    fit = spark.createDataFrame([(p, m, w, 5_000_000.0, 0.2) for p in ("p0", "p1") for m, w in (("claude-opus-5", 1.0), ("claude-fable-5-1", 2.0))], "profile_id string, model string, weight double, limit_tokens double, residual double")
    return windows.calibration_points(o, fit)


_add(
    "calibration_points",
    _fit_points,
    f"""WITH {PRICED_SQL}, {QUOTA_SQL}, s AS (SELECT *, lead(us) OVER w AS end_us, lead(pct) OVER w - pct AS delta_pct FROM quota WHERE window_kind = 'seven_day' WINDOW w AS (PARTITION BY profile_id ORDER BY us)),
o AS (SELECT s.profile_id, s.us AS start_us, s.delta_pct, sum(c.tokens * CASE c.model WHEN 'claude-opus-5' THEN 1.0 WHEN 'claude-fable-5-1' THEN 2.0 ELSE 0 END) AS wt, count(DISTINCT machine_id) AS k
  FROM s JOIN counted c ON c.profile_id = s.profile_id AND c.us >= s.us AND c.us < s.end_us WHERE s.end_us > s.us AND s.end_us - s.us <= 1800000000 AND s.delta_pct > 0 GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY start_us) - 1 AS i, count(*) OVER (PARTITION BY profile_id) AS m FROM o WHERE k <= 1)
SELECT profile_id, start_us, delta_pct, round(wt, 4) AS weighted_tokens, round(wt / 5e6 * 100, 6) AS fitted_pct, round(wt / 5e6 * 100 * 0.8, 6) AS low_pct, round(wt / 5e6 * 100 * 1.2, 6) AS high_pct
FROM n WHERE m <= 1000 OR i IN (SELECT CAST(floor(j * (m - 1) / 999 + 0.5) AS BIGINT) FROM range(0, 1000) r(j))""",
)


def _summary(spark, sf):
    projected = uq.window_projection(spark, sf).select("profile_id", "window_kind", "rate", "eta_ms")
    return windows.summary(_latest(spark, sf).join(projected, ["profile_id", "window_kind"]), uq._now(spark, sf))


_add(
    "summary",
    _summary,
    f"""WITH {_PROJECTION}, st AS (SELECT l.*, p.rate, p.eta_ms, CASE l.window_kind WHEN 'five_hour' THEN 0 ELSE 1 END AS o FROM latest l JOIN projected p USING (profile_id, window_kind)),
f AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY eta_ms IS NULL, eta_ms, o) AS r FROM st)
SELECT f.profile_id, CAST(floor(max(pct) FILTER (r = 1) + 0.5) AS BIGINT) || '%' AS tray, max(window_kind) FILTER (r = 1) AS primary_kind, max(rate) FILTER (r = 1) AS rate, max(window_kind) FILTER (r = 1 AND eta_ms IS NOT NULL) AS soonest_kind, min(eta_ms) AS soonest_eta_ms,
  min(us) AS captured_us, (SELECT n FROM now) - min(us) > 900000000 AS stale, 'five_hour,seven_day' AS kinds FROM f GROUP BY 1""",
)


def _b_listed(spark, sf):
    """Periods of the last two weeks with the moment each started."""
    p = ledger.periods(uq._quota(spark, sf, arrival=True), ties=["event_id"]).withColumn("opened_by_reset", F.col("period") % 2 == 1)
    return windows.listed_periods(windows.period_starts(p, window_us() / ordered.MINUTE_US), uq._now(spark, sf), 2).select("profile_id", "window_kind", "period", "position", "starts_us")


_add(
    "b_periods_listed",
    _b_listed,
    f"""WITH {_PERIODS}, {_NOW}, k AS (SELECT p.* FROM periods p, now WHERE greatest(resets_us, last_us) >= n - 2 * {WEEK})
SELECT profile_id, window_kind, period, CAST(row_number() OVER (PARTITION BY profile_id, window_kind ORDER BY first_us DESC) AS INTEGER) AS position, CASE WHEN period % 2 = 1 THEN first_us ELSE resets_us - CASE window_kind WHEN 'seven_day' THEN {WEEK} ELSE {FIVE} END END AS starts_us FROM k""",
)
_add(
    "b_period_analysis",
    lambda spark, sf: windows.period_analysis(uq._quota(spark, sf), uq._now(spark, sf)),
    f"""WITH {_PROJECTION} SELECT profile_id, window_kind, resets_us, last_pct, CASE WHEN resets_us <= n THEN 0 ELSE rate END AS rate, CASE WHEN resets_us <= n THEN last_pct ELSE lo_pct END AS lo_pct, CASE WHEN resets_us <= n THEN last_pct ELSE mid_pct END AS mid_pct,
  CASE WHEN resets_us <= n THEN last_pct ELSE hi_pct END AS hi_pct, CASE WHEN resets_us > n THEN eta_ms END AS eta_ms FROM projected, now""",
)


def _b_estimate(spark, sf):
    """The cost of a full period: the last five-hour period of each profile against the median of those before it."""
    full = uq.b_full_cost(spark, sf).withColumn("last", F.col("period") == F.max("period").over(Window.partitionBy("profile_id")))
    past = windows.median_of_latest(full.where("NOT last AND cumulative_pct >= 30 AND cost_usd > 0").withColumn("each", F.col("cost_usd") / F.col("cumulative_pct") * 100), ["profile_id"], "period", "each").select("profile_id", F.col("usd").alias("reference_usd"), "windows")
    unpriced = uq._ledger(spark, sf).groupBy("profile_id").agg(F.count_if(F.col("cost_usd").isNull()).alias("unpriced"))
    joined = full.where("last").join(past, "profile_id", "left").join(unpriced, "profile_id")
    estimate = windows.full_cost_estimate(F.col("cost_usd"), F.col("cumulative_pct"), F.col("unpriced"), F.col("reference_usd"))
    return joined.select("profile_id", "period", "reference_usd", "windows", estimate.alias("e")).select("profile_id", "period", "reference_usd", "windows", "e.usd", "e.basis", "e.lower_bound")


_add(
    "b_full_cost_estimate",
    _b_estimate,
    f"""WITH {_LEDGER}, {_PERIODS}, five AS (SELECT * FROM periods WHERE window_kind = 'five_hour'),
c AS (SELECT l.profile_id, p.period, CAST(round(sum(l.cost_usd), 6) AS DOUBLE) AS cost_usd FROM ledger l ASOF JOIN five p ON p.profile_id = l.profile_id AND l.us >= p.first_us GROUP BY 1, 2),
f AS (SELECT f.profile_id, f.period, f.cumulative_pct, c.cost_usd, f.period = max(f.period) OVER (PARTITION BY f.profile_id) AS last FROM five f LEFT JOIN c USING (profile_id, period)),
p AS (SELECT profile_id, cost_usd / cumulative_pct * 100 AS each FROM f WHERE NOT last AND cumulative_pct >= 30 AND cost_usd > 0 QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY period DESC) <= 8),
m AS (SELECT profile_id, round(median(each), 4) AS reference_usd, count(*) AS windows FROM p GROUP BY 1), un AS (SELECT profile_id, count(*) FILTER (cost_usd IS NULL) AS k FROM ledger GROUP BY 1),
e AS (SELECT f.*, reference_usd, windows, k, CASE WHEN cost_usd > 0 AND cumulative_pct > 0 THEN cost_usd / cumulative_pct * 100 END AS own FROM f LEFT JOIN m USING (profile_id) JOIN un USING (profile_id) WHERE last)
SELECT profile_id, period, reference_usd, windows, round(CASE WHEN reference_usd IS NOT NULL AND (cumulative_pct < 20 OR own IS NULL) THEN reference_usd ELSE own END, 4) AS usd,
  CASE WHEN reference_usd IS NOT NULL AND (cumulative_pct < 20 OR own IS NULL) THEN 'reference' WHEN own IS NOT NULL THEN 'current' END AS basis, CASE WHEN reference_usd IS NOT NULL AND (cumulative_pct < 20 OR own IS NULL) THEN false WHEN own IS NOT NULL THEN k > 0 END AS lower_bound FROM e""",
)


# --- the flagship ---------------------------------------------------------------------------------------


def _full(spark, sf):
    """The whole state of every current window.

    Cumulative use, projection (short windows by recent rates, long ones by weekday weights), what came from
    elsewhere, and for short windows who used it, how much they overlapped and how far the local block is off.
    """
    now = uq._now(spark, sf)
    base = uq.windows_current(spark, sf)
    long = uq.calendar_projection(spark, sf).select("profile_id", F.lit("seven_day").alias("window_kind"), *[F.col(c).alias(f"_{c}") for c in ("rate", "mid_pct", "lo_pct", "hi_pct", "eta_ms")])
    last = _latest(spark, sf)
    short = last.where("window_kind = 'five_hour'").select("profile_id", (F.col("resets_us") - FIVE).alias("start_us"), F.col("resets_us").alias("end_us"))
    inside = windows.in_ranges(uq._tokens(spark, sf).select("profile_id", "us", "machine_id", "tokens"), short, ["profile_id"], FIVE)
    used = inside.groupBy("profile_id").agg(F.array_join(F.array_sort(F.collect_set("machine_id")), ",").alias("machines"), F.count("*").alias("events"), F.sum("tokens").alias("tokens"))
    overlap = ordered.multi_machine_overlap(inside, ["profile_id"], "start_us", "end_us").select("profile_id", "overlap")
    offset = windows.window_offset(last.where("window_kind = 'five_hour'").select("profile_id", "resets_us"), ordered.blocks(uq._tokens(spark, sf))).select("profile_id", "offset_min")
    metrics = short.select("profile_id", F.lit("five_hour").alias("window_kind")).join(used, "profile_id", "left").join(overlap, "profile_id", "left").join(offset, "profile_id", "left")
    stale = last.select("profile_id", "window_kind", (F.lit(now) - F.col("us") > 900_000_000).alias("stale"))
    joined = base.join(long, ["profile_id", "window_kind"], "left").join(metrics, ["profile_id", "window_kind"], "left").join(stale, ["profile_id", "window_kind"])
    by_kind = lambda c: F.when(F.col("window_kind") == "seven_day", F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(
        "profile_id", "window_kind", "label", "resets_us", "cumulative_pct", "resets", *[by_kind(c) for c in ("rate", "mid_pct", "lo_pct", "hi_pct", "eta_ms")],
        "observed_pct", "other_pct", "ambiguous_pct", "quiet_spans", "gaps", F.greatest(F.lit(0.0), F.round(F.col("cumulative_pct") - F.col("other_pct"), 6)).alias("local_pct"), "machines", "events", "tokens", "overlap", "offset_min", "stale",
    )


_KINDS = ", ".join(f"CASE w.window_kind WHEN 'seven_day' THEN c.{c} ELSE w.{c} END AS {c}" for c in ("rate", "mid_pct", "lo_pct", "hi_pct", "eta_ms"))


def _full_sql() -> str:
    from meterlark.plans.oracles import ORACLES as older

    return f"""WITH RECURSIVE {PRICED_SQL}, {QUOTA_SQL}, {_LATEST}, {_NOW}, ie AS (
  SELECT c.profile_id, c.us, c.machine_id, c.tokens, l.resets_us FROM counted c JOIN latest l ON l.profile_id = c.profile_id AND l.window_kind = 'five_hour' AND c.us >= l.resets_us - {FIVE} AND c.us < l.resets_us
), used AS (SELECT profile_id, array_to_string(list_sort(list(DISTINCT machine_id)), ',') AS machines, count(*) AS events, CAST(sum(tokens) AS BIGINT) AS tokens FROM ie GROUP BY 1),
mi AS (SELECT profile_id, (us - resets_us + {FIVE}) // 60000000 AS m, count(DISTINCT machine_id) AS k FROM ie GROUP BY 1, 2), ov AS (SELECT profile_id, round(count(*) FILTER (k >= 2) / 300, 6) AS overlap FROM mi GROUP BY 1)
SELECT w.profile_id, w.window_kind, w.label, w.resets_us, w.cumulative_pct, w.resets, {_KINDS}, w.observed_pct, w.other_pct, w.ambiguous_pct, w.quiet_spans, w.gaps, greatest(0, round(w.cumulative_pct - w.other_pct, 6)) AS local_pct,
  u.machines, u.events, u.tokens, ov.overlap, o.offset_min, n - l.us > 900000000 AS stale
FROM ({older["windows_current"]}) w LEFT JOIN ({older["calendar_projection"]}) c ON c.profile_id = w.profile_id AND w.window_kind = 'seven_day' LEFT JOIN used u ON u.profile_id = w.profile_id AND w.window_kind = 'five_hour'
LEFT JOIN ov ON ov.profile_id = w.profile_id AND w.window_kind = 'five_hour' LEFT JOIN ({ORACLES["window_offset"]}) o ON o.profile_id = w.profile_id AND w.window_kind = 'five_hour' JOIN latest l ON l.profile_id = w.profile_id AND l.window_kind = w.window_kind, now"""


_add("windows_current_full", _full, _full_sql())
