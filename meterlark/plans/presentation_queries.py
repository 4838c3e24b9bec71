"""Registered queries of the presentation scalars, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlark.functions import presentation as p
from meterlark.functions import scalars
from meterlark.operators import dedup, ordered
from meterlark.plans import usage_queries
from meterlark.plans.oracles import _PROJECTION
from meterlark.sources import synthetic

QUERIES, ORACLES = {}, {}
_US_DAY = 86_400_000_000


def _add(name: str, query, sql: str | None = None) -> None:
    query.__name__ = name
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _names(spark, sf):
    """Model and project names of every shape, one for each event."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id")
    i = F.col("event_id")
    model = (
        F.when(i % 8 == 0, F.concat(F.lit("claude-opus-"), i % 7)).when(i % 8 == 1, F.concat(F.lit("Claude-Sonnet-4-"), i % 9, F.lit("-20250929"))).when(i % 8 == 2, F.concat(F.lit("claude-3-"), i % 9, F.lit("-haiku")))
        .when(i % 8 == 3, "fable-5[1m]").when(i % 8 == 4, "qwen3.7-plus").when(i % 8 == 5, " opus-4-5@20251101").when(i % 8 == 6, "<synthetic>").otherwise("gpt-x-wm")
    )
    project = (
        F.when(i % 5 == 0, F.concat(F.lit("-home-me-"), F.lit("repo"), i % 11)).when(i % 5 == 1, "0123456789abcdef01").when(i % 5 == 2, "-Claude-scratch-workspaces-org-me-scratch-2026-09-22-105cae").when(i % 5 == 3, "plain")
    )
    return e.select(i, model.alias("model"), project.alias("project"), F.concat(F.lit("session-"), "user_id").alias("session_id"), F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("host"), "user_id")).when(F.col("user_id") % 3 == 1, "").alias("hostname"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("T"), "user_id")).alias("title"))


_add(
    "labels",
    lambda spark, sf: _names(spark, sf).select(
        "event_id", p.model_name(F.col("model")).alias("model_name"), p.model_in_family(F.col("model"), F.lit("opus")).alias("is_opus"), p.counts_toward_quota_exact().alias("counts"), scalars.counts_toward_quota().alias("counts_loosely"),
        p.project_label(F.col("project")).alias("project_label"), p.is_scratch(F.col("project")).alias("is_scratch"), p.session_label(F.col("title"), F.col("session_id")).alias("session_label"),
        p.session_place(F.col("project"), F.col("hostname")).alias("place"), p.machine_label(F.col("hostname"), F.lit("m1")).alias("machine_label"), p.is_work_mode(F.col("model")).alias("work_mode"), p.base_model(F.col("model")).alias("base_model"),
    ),
    """WITH n AS (
  SELECT event_id, user_id, CASE event_id % 8 WHEN 0 THEN 'claude-opus-' || event_id % 7 WHEN 1 THEN 'Claude-Sonnet-4-' || event_id % 9 || '-20250929' WHEN 2 THEN 'claude-3-' || event_id % 9 || '-haiku' WHEN 3 THEN 'fable-5[1m]'
    WHEN 4 THEN 'qwen3.7-plus' WHEN 5 THEN ' opus-4-5@20251101' WHEN 6 THEN '<synthetic>' ELSE 'gpt-x-wm' END AS model,
    CASE event_id % 8 WHEN 0 THEN 'Opus ' || event_id % 7 WHEN 1 THEN 'Sonnet 4.' || event_id % 9 WHEN 2 THEN 'Haiku 3.' || event_id % 9 WHEN 3 THEN 'Fable 5' WHEN 4 THEN 'qwen3.7-plus' WHEN 5 THEN 'Opus 4.5' WHEN 6 THEN '<synthetic>' ELSE 'gpt-x-wm' END AS model_name,
    CASE event_id % 5 WHEN 0 THEN 'repo' || event_id % 11 WHEN 1 THEN '0123456789' WHEN 2 THEN 'scratch 09-22' WHEN 3 THEN 'plain' END AS project_label, event_id % 5 = 2 AS is_scratch,
    CASE user_id % 3 WHEN 0 THEN 'host' || user_id END AS host
  FROM events
) SELECT event_id, model_name, event_id % 8 IN (0, 5) AS is_opus, event_id % 8 IN (0, 2, 3) AS counts, event_id % 8 IN (0, 1, 2, 3, 5) AS counts_loosely, project_label, is_scratch,
  CASE WHEN user_id % 2 = 0 THEN 'T' || user_id ELSE 'untitled · ' || left('session-' || user_id, 8) END AS session_label, concat_ws(' · ', CASE WHEN is_scratch THEN 'scratch' ELSE project_label END, host) AS place,
  coalesce(host, 'm1') AS machine_label, event_id % 8 = 7 AS work_mode, CASE WHEN event_id % 8 = 7 THEN 'gpt-x' ELSE model END AS base_model FROM n""",
)


def _formats(spark, sf):
    u = synthetic.usage(spark, sf)
    n = F.col("cache_read_tokens") * F.col("event_id") * 7 + F.col("output_tokens")
    ms = F.col("event_id") % 9_000 * 61_700 - 100_000
    return u.select(
        "event_id", p.tokens_text(n).alias("tokens"), p.pct_text(F.col("input_tokens") / 8.0).alias("pct"), p.usd_text(F.col("output_tokens") / 4096.0).alias("usd"), p.duration_text(ms).alias("duration"), p.until_text(ms).alias("until_text"),
        p.when_text(F.col("us") + ms * 1000, F.col("us")).alias("moment"), F.round(p.pace(F.lit(300), F.col("us") + ms * 1000, F.col("us")), 6).alias("pace"), p.tray_text(F.col("input_tokens") / 2.0).alias("tray"),
        p.cumulative_text(F.col("input_tokens") / 2.0, F.col("event_id") % 2 == 0).alias("cumulative"), scalars.ring_tone(F.col("input_tokens"), F.col("input_tokens") + F.col("event_id") % 30).alias("tone"),
        scalars.nice_max_pct(F.col("input_tokens").cast("double")).alias("nice_max"), scalars.duration_label(F.col("event_id") * 15).alias("length"), p.share_points(F.col("input_tokens"), F.lit(25.0)).alias("points"), p.ratio_to_pct(F.col("input_tokens") / 128.0).alias("ratio_pct"),
    )


_add(
    "formats",
    _formats,
    f"""WITH {synthetic.USAGE_SQL}, v AS (SELECT *, cache_read_tokens * event_id * 7 + output_tokens AS n, event_id % 9000 * 61700 - 100000 AS ms FROM usage),
w AS (SELECT *, CAST(floor(ms / 60000 + 0.5) AS BIGINT) AS mi, make_timestamp(us + ms * 1000) AS due FROM v)
SELECT event_id, CASE WHEN n >= 1e9 THEN printf('%.2f', round(n / 1e9, 2)) || 'B' WHEN n >= 1e6 THEN printf('%.1f', round(n / 1e6, 1)) || 'M' WHEN n >= 1e3 THEN CAST(floor(n / 1e3 + 0.5) AS BIGINT) || 'K' ELSE n || '' END AS tokens,
  printf('%.1f', floor(input_tokens / 8 * 10 + 0.5) / 10) || '%' AS pct, '$' || CASE WHEN output_tokens / 4096 < 0.1 THEN printf('%.3f', floor(output_tokens / 4096 * 1000 + 0.5) / 1000) ELSE printf('%.2f', floor(output_tokens / 4096 * 100 + 0.5) / 100) END AS usd,
  CASE WHEN ms <= 0 THEN '0:00' WHEN mi >= 1440 THEN (mi // 1440) || 'd ' || printf('%02d', mi % 1440 // 60) || 'h' ELSE (mi // 60) || ':' || printf('%02d', mi % 60) END AS duration,
  CASE WHEN ms <= 60000 THEN 'now' WHEN mi < 60 THEN 'in ' || mi || ' min' WHEN mi >= 1440 THEN 'in ' || (mi // 1440) || ' d' || CASE WHEN mi % 1440 // 60 > 0 THEN ' ' || (mi % 1440 // 60) || ' h' ELSE '' END
    ELSE 'in ' || (mi // 60) || ' h' || CASE WHEN mi % 60 > 0 THEN ' ' || (mi % 60) || ' min' ELSE '' END END AS until_text,
  CASE datediff('day', CAST(ts AS DATE), CAST(due AS DATE)) WHEN 0 THEN strftime(due, '%H:%M') WHEN 1 THEN 'tomorrow ' || strftime(due, '%H:%M') ELSE strftime(due, '%m-%d %a %H:%M') END AS moment,
  round(greatest(0, least(1, (18000000000 - ms * 1000) / 18000000000)), 6) AS pace, CAST(floor(input_tokens / 2 + 0.5) AS BIGINT) || '%' AS tray, CASE WHEN event_id % 2 = 0 THEN '≥' ELSE '' END || CAST(floor(input_tokens / 2 + 0.5) AS BIGINT) || '%' AS cumulative,
  CASE WHEN input_tokens >= 90 THEN 'danger' WHEN input_tokens >= 70 OR input_tokens + event_id % 30 >= 95 THEN 'warn' ELSE 'ok' END AS tone,
  CAST(CASE WHEN input_tokens * 1.15 <= 10 THEN 10 WHEN input_tokens * 1.15 <= 25 THEN 25 WHEN input_tokens * 1.15 <= 50 THEN 50 WHEN input_tokens * 1.15 <= 75 THEN 75 WHEN input_tokens * 1.15 <= 100 THEN 100 ELSE 110 END AS INTEGER) AS nice_max,
  CASE WHEN event_id * 15 % 1440 = 0 THEN (event_id * 15 // 1440) || 'd' WHEN event_id * 15 % 60 = 0 THEN (event_id * 15 // 60) || 'h' ELSE (event_id * 15) || 'm' END AS length, input_tokens * 25.0 / 100 AS points, input_tokens / 128 * 100 AS ratio_pct FROM w""",
)


def _states(spark, sf):
    """The latest state of every window of both kinds, as a dashboard reads it."""
    q = synthetic.quota(spark, sf)
    last = dedup.latest_by(q, ["profile_id", "window_kind"], "us")
    projected = usage_queries.window_projection(spark, sf).select("profile_id", "window_kind", "mid_pct", "eta_ms")
    return last.join(projected, ["profile_id", "window_kind"])


_STATES = f"{_PROJECTION}, st AS (SELECT l.*, p.mid_pct, p.eta_ms FROM latest l JOIN projected p USING (profile_id, window_kind))"


def _shown(spark, sf):
    now = usage_queries._now(spark, sf)
    shown = p.shown_windows(_states(spark, sf))
    return shown.select("profile_id", "window_kind", "position", p.window_family(F.col("window_kind")).alias("family"), p.is_active(F.col("resets_us")).alias("active"), p.is_stale(F.col("us"), F.lit(now)).alias("stale"))


_add(
    "windows_shown",
    _shown,
    f"""WITH {_STATES} SELECT profile_id, window_kind, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY CASE window_kind WHEN 'five_hour' THEN 0 ELSE 1 END) AS INTEGER) AS position, CAST(NULL AS VARCHAR) AS family,
  true AS active, (SELECT n FROM now) - us > 900000000 AS stale FROM st""",
)
_add(
    "headline",
    lambda spark, sf: p.headline(_states(spark, sf), usage_queries._now(spark, sf)),
    f"""WITH {_STATES}, one AS (
  SELECT profile_id, min(eta_ms) AS eta, arg_min(window_kind, (eta_ms, window_kind)) FILTER (eta_ms IS NOT NULL) AS eta_kind, max(mid_pct) FILTER (mid_pct >= 90) AS hot, arg_max(window_kind, (mid_pct, window_kind)) FILTER (mid_pct >= 90) AS hot_kind,
    max(pct) FILTER (window_kind = 'seven_day') AS week FROM st GROUP BY 1
) SELECT profile_id, CASE WHEN eta IS NOT NULL THEN CASE WHEN eta - (SELECT n FROM now) / 1000 < 2700000 THEN 'danger' ELSE 'warn' END WHEN hot IS NOT NULL THEN 'warn' ELSE 'ok' END AS tone,
  CASE WHEN eta IS NOT NULL THEN 'exhausts' WHEN hot IS NOT NULL THEN 'hot' ELSE 'safe' END AS what, CASE WHEN eta IS NOT NULL THEN eta_kind WHEN hot IS NOT NULL THEN hot_kind ELSE 'seven_day' END AS window_kind,
  CASE WHEN eta IS NOT NULL THEN CAST(eta AS DOUBLE) WHEN hot IS NOT NULL THEN hot ELSE week END AS figure FROM one""",
)
_add("windows_tight", lambda spark, sf: p.tight(_states(spark, sf)), f"WITH {_STATES} SELECT profile_id, bool_or(eta_ms IS NOT NULL OR mid_pct >= 100) AS tight FROM st GROUP BY 1")


def _last_day(spark, sf):
    now = usage_queries._now(spark, sf)
    return p.time_range(synthetic.usage(spark, sf), None, None, now, _US_DAY).groupBy("profile_id").agg(F.count("*").alias("events"))


_add("time_range_day", _last_day, f"WITH {synthetic.USAGE_SQL}, n AS (SELECT max(us) AS n FROM usage) SELECT profile_id, count(*) AS events FROM usage, n WHERE us >= n - {_US_DAY} AND us < n GROUP BY 1")


def _ticks(spark, sf):
    """The UTC hours from the first event to the last with their events, 0 where there are none."""
    ends = synthetic.usage(spark, sf).agg(F.min("us"), F.max("us")).first()
    hours = p.hour_ticks(spark, (ends[0] or 0) // 1000, (ends[1] or 0) // 1000)
    counted = synthetic.usage(spark, sf).groupBy((F.floor(F.col("us") / ordered.HOUR_US) * 3_600_000).alias("tick_ms")).agg(F.count("*").alias("events"))
    return hours.join(counted, "tick_ms", "left").select("tick_ms", F.coalesce("events", F.lit(0)).alias("events"))


_add(
    "hour_ticks",
    _ticks,
    f"""WITH {synthetic.USAGE_SQL}, r AS (SELECT min(us) // 1000 AS a, max(us) // 1000 AS b FROM usage), t AS (SELECT unnest(range(a // 3600000 * 3600000, b, 3600000)) AS tick_ms FROM r),
c AS (SELECT us // 3600000000 * 3600000 AS tick_ms, count(*) AS n FROM usage GROUP BY 1) SELECT tick_ms, coalesce(n, 0) AS events FROM (SELECT * FROM t ORDER BY 1 LIMIT 2000) t LEFT JOIN c USING (tick_ms)""",
)


def _local_days(spark, sf):
    """The local days of a zone with summer time, midnights in microseconds; their lengths are 23 to 25 hours."""
    ticks = p.day_ticks(spark, 1_772_000_000_000_000, 1_775_500_000_000_000, "Europe/Berlin")
    return ticks.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "tick_us")


_add(
    "local_day_ticks",
    _local_days,
    """SELECT strftime(d, '%Y-%m-%d') AS day, epoch_us(timezone('Europe/Berlin', d)) AS tick_us
FROM (SELECT unnest(generate_series(TIMESTAMP '2026-02-25', TIMESTAMP '2026-04-07', INTERVAL 1 DAY)) AS d) WHERE epoch_us(timezone('Europe/Berlin', d)) < 1775500000000000""",
)
