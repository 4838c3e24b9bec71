"""Registered queries of window identity and of the whole current state, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.functions.scalars import counts_toward_quota, quota_tokens
from meterlark.operators import current, ordered
from meterlark.plans import usage_queries as uq
from meterlark.plans.oracles import PRICED_SQL
from meterlark.sources import synthetic
from meterlark.sources.synthetic import JITTER_SQL, QUOTA_SQL

QUERIES, ORACLES = {}, {}
MIN, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000
FIVE, WEEK, LOOK = 5 * HOUR, 7 * DAY, 14 * DAY + 5 * HOUR


def _add(name: str, query, sql: str) -> None:
    query.__name__ = name
    QUERIES[name], ORACLES[name] = query, sql


def _told(spark: SparkSession, sf: str, arrival: bool = False) -> DataFrame:
    return synthetic.jittered(uq._quota(spark, sf, arrival=arrival))


def _identified(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative use of every window of a feed whose reset times jitter: by window as without the jitter."""
    named = current.identify_windows(_told(spark, sf, True)).where("window_us IS NOT NULL")
    return ordered.cumulative_usage(named, ["profile_id", "window_kind", "window_us"], ties=["event_id"])


def _named(rows: str, kinds: str) -> str:
    """win and named: rows(profile_id, window_kind, plain_us, us, resets_us) with the end of their window."""
    return f"""win AS (
  SELECT profile_id, window_kind, plain_us, arg_max(resets_us, us) FILTER (resets_us IS NOT NULL) AS window_us FROM {rows} WHERE {kinds} GROUP BY ALL
), held AS (
  SELECT *, last_value(own_us IGNORE NULLS) OVER (PARTITION BY profile_id, window_kind ORDER BY us ROWS UNBOUNDED PRECEDING) AS held_us
  FROM (SELECT t.*, CASE WHEN t.resets_us IS NOT NULL THEN w.window_us END AS own_us FROM {rows} t JOIN win w USING (profile_id, window_kind, plain_us) WHERE {kinds})
), named AS (SELECT *, CASE WHEN resets_us IS NOT NULL THEN own_us WHEN us < held_us THEN held_us END AS window_us FROM held)"""


_add(
    "window_identity",
    _identified,
    f"""WITH {QUOTA_SQL}, {JITTER_SQL}, {_named("told", "true")}, lagged AS (
  SELECT *, lag(pct) OVER w AS pp, lag(us) OVER w AS pu FROM named WHERE window_us IS NOT NULL WINDOW w AS (PARTITION BY profile_id, window_kind, window_us ORDER BY us)
), seg AS (
  SELECT *, CAST(sum(CASE WHEN pp - pct >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id, window_kind, window_us ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM lagged
), peaks AS (
  SELECT profile_id, window_kind, window_us, segment, greatest(0, max(pct)) AS peak, arg_min(coalesce(pu, -1), us) AS before, min(us) AS first, arg_max(pct, us) AS last_pct FROM seg GROUP BY ALL
)
SELECT profile_id, window_kind, window_us, round(sum(peak), 6) AS cumulative_pct, max(segment) AS resets, arg_max(CASE WHEN segment > 0 THEN before ELSE first END, segment) AS current_start_us, arg_max(last_pct, segment) AS last_pct FROM peaks GROUP BY ALL""",
)


def _breakdowns(quota: DataFrame) -> DataFrame:
    """A product breakdown with each sample of the week: the week's points, and a share of other products that rises and falls a little."""
    q = quota.where("window_kind = 'seven_day'")
    share = F.floor(F.col("us") / 1_000_000) % 30
    week = F.floor(F.col("us") / WEEK) * WEEK
    return q.select("profile_id", "us", F.col("pct").alias("weekly_pct"), share.cast("double").alias("share_pct"), (week + F.col("us") % 1000).alias("week_start_us"))


def _state(spark: SparkSession, sf: str) -> DataFrame:
    """The whole state of every current window, over a feed whose reset times jitter."""
    told = _told(spark, sf)
    events = uq.priced_usage(spark, sf).where(counts_toward_quota()).withColumn("tokens", quota_tokens())
    return current.window_states(told, events, _breakdowns(told), uq._now(spark, sf))


_RATES = """SELECT profile_id, window_kind, arg_max(pct, us) AS last_pct, coalesce(sum(r * (CASE WHEN k = 1 THEN 1 ELSE 1 - pow(2, -dt / 10) END) * pow(2, -later / 10)), 0) AS rate, coalesce(quantile_cont(r, 0.25), 0) AS low, coalesce(quantile_cont(r, 0.75), 0) AS high
  FROM (SELECT *, count(r) OVER (PARTITION BY profile_id, window_kind ORDER BY us ROWS UNBOUNDED PRECEDING) AS k, coalesce(sum(dt) OVER (PARTITION BY profile_id, window_kind ORDER BY us DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later
    FROM (SELECT *, CASE WHEN fine THEN (us - pu) / 6e7 END AS dt, CASE WHEN fine THEN (pct - pp) / ((us - pu) / 6e7) END AS r
      FROM (SELECT *, us > pu AND pct >= pp AND n - us <= 1800000000 AS fine
        FROM (SELECT s.*, lag(us) OVER w AS pu, lag(pct) OVER w AS pp FROM (SELECT profile_id, window_kind, us, pct, n FROM steps WHERE segment = newest) s WINDOW w AS (PARTITION BY profile_id, window_kind ORDER BY us)))))
  GROUP BY ALL"""


def _state_sql() -> str:
    from meterlark.plans.window_queries import _RISE

    base = f"""WITH RECURSIVE {PRICED_SQL}, {QUOTA_SQL}, {JITTER_SQL}, now AS (SELECT max(epoch_us(ts)) AS n FROM events),
rs AS (SELECT t.*, n FROM told t, now WHERE us BETWEEN n - {LOOK} AND n),
lt AS (
  SELECT *, coalesce(resets_us, n + width) AS end_us, coalesce(resets_us, n + width) - width AS nominal
  FROM (SELECT profile_id, window_kind, n, max(us) AS captured_us, arg_max(pct, us) AS pct, arg_max({{'r': resets_us}}, us).r AS resets_us, CASE window_kind WHEN 'seven_day' THEN {WEEK} ELSE {FIVE} END AS width FROM rs GROUP BY ALL)
), nr AS (SELECT r.profile_id, r.window_kind, r.us, r.pct, coalesce(abs(r.resets_us - l.resets_us) > 600000000, false) AS alien, l.end_us, l.nominal FROM rs r JOIN lt l USING (profile_id, window_kind) WHERE r.us >= l.nominal),
wn AS (SELECT l.*, greatest(l.nominal, coalesce(a.last, l.nominal)) AS start_us FROM lt l LEFT JOIN (SELECT profile_id, window_kind, max(us) FILTER (alien) AS last FROM nr GROUP BY ALL) a USING (profile_id, window_kind)),
ow AS (SELECT r.profile_id, r.window_kind, r.us, r.pct, w.start_us, w.n FROM nr r JOIN wn w USING (profile_id, window_kind) WHERE NOT alien AND r.us >= w.start_us),
ue AS (SELECT profile_id, us, machine_id, session_id, tokens, cost_usd, output_final FROM counted, now WHERE us >= n - {5 * WEEK + FIVE}),
sn AS (SELECT o.*, e.us AS event FROM ow o ASOF LEFT JOIN (SELECT DISTINCT profile_id, us FROM ue, now WHERE us < n) e ON e.profile_id = o.profile_id AND o.us > e.us),
lg AS (SELECT *, lag(us) OVER w AS pu, lag(pct) OVER w AS pp, coalesce(event >= us - 1800000000 AND event >= start_us, false) AS busy FROM sn WINDOW w AS (PARTITION BY profile_id, window_kind ORDER BY us)),
sg AS (SELECT *, CAST(sum(CASE WHEN pp - pct >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id, window_kind ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM lg),
steps AS (SELECT *, max(segment) OVER (PARTITION BY profile_id, window_kind) AS newest, us > pu AND us - pu <= 1800000000 AND pct > pp AS up, us > pu AND us - pu > 1800000000 AS far FROM sg),
cu AS (SELECT profile_id, window_kind, sum(peak) AS s, max(segment) AS resets FROM (SELECT profile_id, window_kind, segment, greatest(0, max(pct)) AS peak FROM steps GROUP BY ALL) GROUP BY ALL),
st AS (SELECT w.*, round(greatest(coalesce(s, 0), pct), 6) AS cum, coalesce(resets, 0) AS resets FROM wn w LEFT JOIN cu USING (profile_id, window_kind)),
rt AS ({_RATES}), fa AS (SELECT s.*, r.last_pct, r.rate, r.low, r.high, greatest((s.end_us - s.n) / 6e7, 0) AS remaining FROM rt r JOIN st s USING (profile_id, window_kind)),
line AS (
  SELECT profile_id, window_kind, round(rate, 6) AS rate, round(least(100, greatest(0, last_pct + rate * remaining)), 4) AS mid_pct, round(least(100, greatest(0, last_pct + least(low, rate) * remaining)), 4) AS lo_pct,
    round(least(100, greatest(0, last_pct + greatest(high, rate) * remaining)), 4) AS hi_pct, CASE WHEN rate > 0 AND last_pct < 100 AND (100 - last_pct) / rate <= remaining THEN CAST(floor((n + (100 - last_pct) / rate * 6e7) / 1000) AS BIGINT) END AS eta_ms
  FROM fa WHERE window_kind = 'five_hour'
)"""
    long = f"""lw AS (SELECT * FROM fa WHERE window_kind = 'seven_day'),
hi AS (SELECT e.profile_id, e.us // {DAY} AS day, sum(tokens) AS t FROM ue e JOIN lw w USING (profile_id) WHERE e.us >= w.start_us - 4 * {WEEK} AND e.us < w.n GROUP BY ALL),
bd0 AS (SELECT profile_id, (day + 4) % 7 AS weekday, avg(t) AS m, count(*) AS k FROM hi GROUP BY ALL), oa AS (SELECT profile_id, avg(m) AS mean, sum(k) AS days FROM bd0 GROUP BY ALL),
dy AS (SELECT w.*, unnest(range(start_us // {DAY}, (end_us - 1) // {DAY} + 1)) AS day FROM lw w),
sd AS (
  SELECT h.*, CASE WHEN o.days >= 7 AND o.mean > 0 AND b.m IS NOT NULL THEN round(greatest(0.1, least(5, b.m / o.mean)), 6) ELSE 1 END AS w,
    greatest(least(n, end_us, (day + 1) * {DAY}) - greatest(start_us, day * {DAY}), 0) / {DAY} * w AS gone, greatest(least(end_us, (day + 1) * {DAY}) - greatest(n, start_us, day * {DAY}), 0) / {DAY} * w AS ahead
  FROM dy h LEFT JOIN oa o USING (profile_id) LEFT JOIN bd0 b ON b.profile_id = h.profile_id AND b.weekday = (h.day + 4) % 7
), tl AS (SELECT profile_id, sum(gone) AS e, sum(ahead) AS a FROM sd GROUP BY 1),
et AS (
  SELECT profile_id, min(CASE WHEN ahead > 0 AND need > before AND need <= before + ahead THEN CAST(floor((greatest(n, start_us, day * {DAY}) + (need - before) / w * {DAY}) / 1000 + 0.5) AS BIGINT) END) AS eta_ms
  FROM (SELECT s.*, coalesce(sum(ahead) OVER (PARTITION BY s.profile_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, CASE WHEN cum > 0 AND pct < 100 AND e > 0 THEN (100 - pct) / (cum / e) END AS need FROM sd s JOIN tl USING (profile_id)) GROUP BY 1
), ic AS (
  SELECT w.*, e > 0 AND a > 0 AS moving, CASE WHEN e > 0 AND a > 0 THEN cum / e * a ELSE 0 END AS rise, CASE WHEN rate > 0 THEN least(1, greatest(0, low / rate)) ELSE 1 END AS k25, CASE WHEN rate > 0 THEN greatest(1, high / rate) ELSE 1 END AS k75 FROM lw w JOIN tl USING (profile_id)
), pj AS (
  SELECT * FROM line UNION ALL SELECT profile_id, window_kind, round(CASE WHEN moving AND end_us > n THEN (least(100, greatest(0, pct + rise)) - pct) / ((end_us - n) / 6e7) ELSE 0 END, 6) AS rate, round(least(100, greatest(0, pct + rise)), 4) AS mid_pct,
    round(least(100, greatest(0, pct + k25 * rise)), 4) AS lo_pct, round(least(100, greatest(0, pct + k75 * rise)), 4) AS hi_pct, eta_ms FROM ic JOIN et USING (profile_id)
)"""
    shares = f"""bd AS (
  SELECT profile_id, us, pct AS weekly_pct, (us // 1000000) % 30 AS share_pct, us // {WEEK} * {WEEK} + us % 1000 AS week_start_us, lag(pct) OVER w AS pp, lag(us // {WEEK}) OVER w AS pr, us // {WEEK} AS wk FROM rs WHERE window_kind = 'seven_day' WINDOW w AS (PARTITION BY profile_id ORDER BY us)
), rn AS (
  SELECT *, CAST(sum(CASE WHEN pp IS NOT NULL AND (pr <> wk OR pp - weekly_pct >= 2) THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run, weekly_pct * share_pct / 100 AS y FROM bd
), ix AS (SELECT *, row_number() OVER w AS i, sum(y) OVER (PARTITION BY profile_id, run ORDER BY us ROWS UNBOUNDED PRECEDING) AS c FROM rn WINDOW w AS (PARTITION BY profile_id, run ORDER BY us)),
sp AS (SELECT a.profile_id, a.run, a.i AS a, z.i AS z, (z.c - a.c + a.y) / (z.i - a.i + 1) AS m FROM ix a JOIN ix z ON a.profile_id = z.profile_id AND a.run = z.run AND z.i >= a.i),
lo AS (SELECT profile_id, run, a, z, min(m) OVER (PARTITION BY profile_id, run, a ORDER BY z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least FROM sp),
ft AS (SELECT profile_id, run, z AS i, max(least) AS value FROM lo GROUP BY 1, 2, 3), series AS (SELECT x.profile_id, x.us, x.run, x.week_start_us, f.value FROM ix x JOIN ft f USING (profile_id, run, i)),
summed AS (
  SELECT *, sum(CASE WHEN lag_run IS NULL THEN 0 WHEN lag_run <> run THEN value ELSE value - lag_value END) OVER (PARTITION BY profile_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT *, lag(run) OVER w AS lag_run, lag(value) OVER w AS lag_value FROM series WINDOW w AS (PARTITION BY profile_id ORDER BY us))
), firsts AS (SELECT profile_id, arg_min(value, us) AS first, arg_min(week_start_us, us) AS began FROM series GROUP BY 1),
rp AS (SELECT a.profile_id, a.us, a.pct AS s, b.pct AS l FROM rs a JOIN rs b ON a.profile_id = b.profile_id AND a.us = b.us AND a.window_kind = 'five_hour' AND b.window_kind = 'seven_day' WHERE a.us >= a.n - {14 * DAY}),
rg AS (SELECT *, lag(s) OVER w AS ps, lag(l) OVER w AS pl, lag(us) OVER w AS pu FROM rp WINDOW w AS (PARTITION BY profile_id ORDER BY us)),
rc AS (SELECT *, sum(CASE WHEN s < ps OR l < pl OR us - pu > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM rg),
re AS (SELECT profile_id, k, arg_max(s, us) - arg_min(s, us) AS ds, arg_max(l, us) - arg_min(l, us) AS dl FROM rc GROUP BY 1, 2),
ratio AS (SELECT profile_id, CASE WHEN sum(dl) >= 5 AND sum(ds) > 0 THEN round(sum(dl) / sum(ds), 6) END AS ratio FROM re GROUP BY 1),
sc AS (SELECT l.profile_id, k.kind AS window_kind, CASE k.kind WHEN 'seven_day' THEN 1 ELSE ratio END AS scale, round(l.pct / 100 * CASE k.kind WHEN 'seven_day' THEN 1 ELSE ratio END, 6) AS quantum FROM lt l LEFT JOIN ratio USING (profile_id), (VALUES ('seven_day'), ('five_hour')) k(kind) WHERE l.window_kind = 'seven_day'),
d AS (
  SELECT profile_id, window_kind, 'ambiguous' AS what, pu AS from_us, us AS to_us, pct - pp AS most FROM steps WHERE up AND busy
  UNION ALL SELECT profile_id, window_kind, 'unobserved', start_us, us, pct FROM steps WHERE pu IS NULL AND pct > 0 AND us > start_us
  UNION ALL SELECT profile_id, window_kind, 'whole', start_us, n, NULL FROM wn
), r AS (SELECT d.*, {_RISE} AS raw FROM d ASOF LEFT JOIN summed a ON a.profile_id = d.profile_id AND d.from_us >= a.us ASOF LEFT JOIN summed z ON z.profile_id = d.profile_id AND d.to_us >= z.us LEFT JOIN firsts f ON f.profile_id = d.profile_id),
ex AS (
  SELECT r.profile_id, r.window_kind, max(round(i * scale + 1e-9, 4)) FILTER (what = 'whole') AS noncode_pct, coalesce(sum(least(most, greatest(0, i * scale))) FILTER (what <> 'whole'), 0) AS explained, any_value(scale) AS scale, any_value(quantum) AS quantum
  FROM (SELECT *, CASE WHEN to_us <= from_us THEN 0 ELSE raw END AS i FROM r) r JOIN sc USING (profile_id, window_kind) WHERE scale IS NOT NULL GROUP BY 1, 2
), qa AS (
  SELECT profile_id, window_kind, round(coalesce(sum(pct - pp) FILTER (up), 0), 6) AS observed_pct, round(coalesce(sum(pct - pp) FILTER (up AND NOT busy), 0), 6) AS other_lower_pct, round(coalesce(sum(pct - pp) FILTER (up AND busy), 0), 6) AS ambiguous_pct,
    greatest(0, max(pct) FILTER (pu IS NULL)) AS unobserved_pct, count(*) FILTER (us > pu AND NOT far) AS spans, count(*) FILTER (up AND NOT busy) AS quiet_spans, count(*) FILTER (far) AS nfar FROM steps GROUP BY 1, 2
)"""
    users = f"""sh AS (SELECT * FROM wn WHERE window_kind = 'five_hour'),
ne AS (SELECT e.*, w.start_us, w.end_us FROM ue e JOIN sh w USING (profile_id) WHERE e.us >= w.start_us - width AND e.us < greatest(w.end_us, w.n)), ie AS (SELECT * FROM ne WHERE us >= start_us AND us < end_us),
us1 AS (SELECT profile_id, array_to_string(list_sort(list(DISTINCT machine_id)), ',') AS machines, count(*) AS events, CAST(sum(tokens) AS BIGINT) AS tokens FROM ie GROUP BY 1),
mi AS (SELECT profile_id, start_us, end_us, (us - start_us) // {MIN} AS m, count(DISTINCT machine_id) AS k FROM ie GROUP BY ALL), ov AS (SELECT profile_id, round(count(*) FILTER (k >= 2) / greatest(1, ceil((end_us - start_us) / {MIN})), 6) AS overlap FROM mi GROUP BY profile_id, start_us, end_us),
cr AS (SELECT profile_id, round(avg(CASE WHEN (a < s AND s < b) OR (a < e AND e < b) THEN 1.0 ELSE 0 END), 6) AS cut_rate FROM (SELECT profile_id, session_id, min(us) AS a, max(us) AS b, any_value(start_us) AS s, any_value(end_us) AS e FROM ne GROUP BY 1, 2) GROUP BY 1),
hrs AS (SELECT DISTINCT profile_id, us // {HOUR} AS hour FROM ne), bs AS (
  SELECT profile_id, min(hour) AS hour FROM hrs GROUP BY 1 UNION ALL SELECT b.profile_id, (SELECT min(h.hour) FROM hrs h WHERE h.profile_id = b.profile_id AND h.hour >= b.hour + 5) FROM bs b WHERE b.hour IS NOT NULL
), ofs AS (SELECT w.profile_id, round((w.end_us - max((b.hour + 5) * {HOUR})) / 6e7, 6) AS offset_min FROM sh w JOIN bs b USING (profile_id) WHERE b.hour * {HOUR} <= w.end_us GROUP BY w.profile_id, w.end_us)"""
    reference = f"""{_named("rs", "window_kind = 'five_hour'")},
en AS (SELECT DISTINCT profile_id, window_us AS end_us FROM named WHERE window_us <= n AND window_us > n - {LOOK}),
so AS (SELECT profile_id, window_us AS end_us, us, pct FROM named JOIN (SELECT DISTINCT profile_id, end_us AS window_us FROM en) USING (profile_id, window_us) WHERE us >= window_us - {FIVE} AND us < window_us),
ev AS (SELECT c.profile_id, e.end_us, c.us, c.cost_usd FROM ue c JOIN en e ON e.profile_id = c.profile_id AND c.us >= e.end_us - {FIVE} AND c.us < e.end_us),
rl AS (SELECT s.*, v.us AS event FROM so s ASOF LEFT JOIN (SELECT DISTINCT profile_id, end_us, us FROM ev) v ON v.profile_id = s.profile_id AND v.end_us = s.end_us AND s.us > v.us),
rm AS (SELECT *, lag(us) OVER w AS pu, lag(pct) OVER w AS pp FROM rl WINDOW w AS (PARTITION BY profile_id, end_us ORDER BY us)),
rk AS (SELECT *, sum(CASE WHEN pp - pct >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id, end_us ORDER BY us ROWS UNBOUNDED PRECEDING) AS segment, us - pu > 1800000000 AS far, us - pu <= 1800000000 AND pct > pp AS up, coalesce(event >= us - 1800000000, false) AS busy FROM rm),
ru AS (SELECT profile_id, end_us, sum(peak) AS used, max(b) AS last_us FROM (SELECT profile_id, end_us, segment, greatest(0, max(pct)) AS peak, max(us) AS b FROM rk GROUP BY ALL) GROUP BY ALL),
rq AS (SELECT profile_id, end_us, coalesce(sum(pct - pp) FILTER (up AND NOT busy), 0) AS other, count(*) FILTER (far) AS gaps FROM rk GROUP BY ALL),
sp2 AS (SELECT profile_id, end_us, sum(cost_usd) AS usd, count(*) FILTER (cost_usd IS NULL) AS unpriced FROM ev GROUP BY ALL),
rf AS (SELECT u.profile_id, u.end_us, CAST(usd AS DOUBLE) / (used - least(used, other)) * 100 AS full_usd FROM ru u JOIN rq USING (profile_id, end_us) JOIN sp2 USING (profile_id, end_us) WHERE u.end_us - last_us <= 1800000000 AND unpriced = 0 AND usd > 0 AND gaps = 0 AND used - least(used, other) >= 30),
ref AS (SELECT profile_id, round(median(round(full_usd, 4)), 4) AS reference_usd, count(*) AS reference_windows FROM (SELECT * FROM rf QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY end_us DESC) <= 8) GROUP BY 1)"""
    return f"""{base}, {long}, {shares}, {users}, {reference}, al AS (
  SELECT s.*, p.rate, p.lo_pct, p.mid_pct, p.hi_pct, p.eta_ms, q.* EXCLUDE (profile_id, window_kind), x.noncode_pct, coalesce(x.scale = 1 AND x.noncode_pct IS NOT NULL, false) AS by_share,
    CASE WHEN coalesce(x.scale = 1 AND x.noncode_pct IS NOT NULL, false) THEN greatest(0, least(cum, x.noncode_pct)) ELSE greatest(0, least(cum, coalesce(other_lower_pct, 0) + CASE WHEN x.quantum IS NULL THEN 0 ELSE greatest(0, x.explained - greatest(0, x.quantum)) END)) END AS other
  FROM st s LEFT JOIN pj p USING (profile_id, window_kind) LEFT JOIN qa q USING (profile_id, window_kind) LEFT JOIN ex x USING (profile_id, window_kind)
)
SELECT a.profile_id, a.window_kind, CASE a.window_kind WHEN 'five_hour' THEN '5h' ELSE '7d' END AS label, pct, captured_us, n - captured_us > 900000000 AS stale, resets_us, CASE WHEN resets_us IS NOT NULL THEN start_us END AS start_us, cum AS cumulative_pct, resets, rate, lo_pct, mid_pct, hi_pct, eta_ms,
  least(100, greatest(0, 100 - pct)) AS waste_pct, observed_pct, other_lower_pct, ambiguous_pct, unobserved_pct, quiet_spans, nfar > 0 AS has_gap, noncode_pct, round(other, 4) AS other_pct, round(greatest(0, cum - round(other, 4)), 4) AS local_pct,
  coalesce((spans > 0 AND nfar = 0 AND unobserved_pct <= 0) OR by_share, false) AS usable, CASE WHEN a.window_kind = 'five_hour' THEN coalesce(machines, '') END AS machines, CASE WHEN a.window_kind = 'five_hour' THEN coalesce(events, 0) END AS events,
  CASE WHEN a.window_kind = 'five_hour' THEN coalesce(tokens, 0) END AS tokens, CASE WHEN a.window_kind = 'five_hour' THEN coalesce(overlap, 0) END AS overlap, CASE WHEN a.window_kind = 'five_hour' THEN coalesce(cut_rate, 0) END AS cut_rate, offset_min, reference_usd, reference_windows
FROM al a LEFT JOIN us1 ON us1.profile_id = a.profile_id AND a.window_kind = 'five_hour' LEFT JOIN ov ON ov.profile_id = a.profile_id AND a.window_kind = 'five_hour' LEFT JOIN cr ON cr.profile_id = a.profile_id AND a.window_kind = 'five_hour'
LEFT JOIN ofs ON ofs.profile_id = a.profile_id AND a.window_kind = 'five_hour' LEFT JOIN ref ON ref.profile_id = a.profile_id AND a.window_kind = 'five_hour'"""


_add("windows_state", _state, _state_sql())
