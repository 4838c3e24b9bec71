"""Registered queries of the second ledger's files and buckets, of profiles, titles and boundaries, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlark.functions import presentation
from meterlark.functions.scalars import counts_toward_quota, quota_tokens
from meterlark.operators import dedup, ledger, ordered, rollout
from meterlark.operators import usage as u
from meterlark.plans import usage_queries as uq
from meterlark.plans.oracles import _LEDGER, PRICED_SQL
from meterlark.plans.source_queries import ORACLES as SOURCE_ORACLES
from meterlark.sources import logs, raw, synthetic
from meterlark.sources.synthetic import QUOTA_SQL, USAGE_SQL

QUERIES, ORACLES = {}, {}
FIVE = 18_000_000_000


def _add(name: str, query, sql: str) -> None:
    query.__name__ = name
    QUERIES[name], ORACLES[name] = query, sql


# --- session files --------------------------------------------------------------------------------------


def _rollout_events(spark, sf):
    parsed = rollout.parse_rollouts(raw.rollout_lines(spark, sf))
    events = rollout.rollout_events(parsed)
    return events.select("event_id", "session_id", "turn_id", "us", "model", "model_provider", "reasoning_effort", "project", "input_tokens", "output_tokens", "total_tokens", F.array_join("flags", ",").alias("flags"))


_FILES = """own AS (
  SELECT event_id, user_id, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS i, CAST(floor(value * 10) AS BIGINT) AS o, CASE WHEN event_id % 7 = 0 THEN 5 ELSE 0 END AS x FROM events
), files AS (
  SELECT *, CAST(sum(i + x) OVER w AS BIGINT) AS ti, CAST(sum(o) OVER w AS BIGINT) AS tot, row_number() OVER w AS n FROM own WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)
)"""
_add(
    "rollout_events",
    _rollout_events,
    f"""WITH {_FILES} SELECT 'codex:v1:' || sha256('["cumulative","s' || user_id || '","t' || user_id || '",' || ti || ',' || tot || ']') AS event_id, 's' || user_id AS session_id, 't' || user_id AS turn_id, us // 1000 * 1000 AS us, 'gpt-a' AS model, 'p' AS model_provider, 'high' AS reasoning_effort,
  '/w/' || user_id AS project, i AS input_tokens, o AS output_tokens, i + o AS total_tokens, CASE WHEN x = 0 THEN '' WHEN n = 1 THEN 'initial_cumulative_history_unattributed,cumulative_gap,' ELSE 'last_usage_mismatch,cumulative_gap,' END || 'configured_account_history' AS flags FROM files""",
)


def _rollout_warnings(spark, sf):
    parsed = rollout.parse_rollouts(raw.rollout_lines(spark, sf))
    each = parsed.select("path", F.explode("warnings").alias("warning"), F.size("withheld").alias("withheld"))
    return each.groupBy("path", "warning").agg(F.count("*").alias("lines"), F.count_if(F.col("withheld") > 0).alias("withheld"))


_add(
    "rollout_warnings",
    _rollout_warnings,
    f"""WITH {_FILES}, w AS (
  SELECT user_id, 'invalid_json' AS warning, true AS held FROM files WHERE event_id % 10 = 4
  UNION ALL SELECT user_id, unnest(CASE WHEN n = 1 THEN ['initial_cumulative_history_unattributed', 'cumulative_gap'] ELSE ['last_usage_mismatch', 'cumulative_gap'] END), false FROM files WHERE x > 0
) SELECT '/rollouts/s' || user_id || '.jsonl' AS path, warning, count(*) AS lines, count(*) FILTER (held) AS withheld FROM w GROUP BY 1, 2""",
)


# --- buckets -----------------------------------------------------------------------------------------------

ZONE = "Asia/Shanghai"


def _buckets(spark, sf):
    rows = uq._ledger(spark, sf).join(synthetic.usage(spark, sf).select("event_id", "project", "session_id"), "event_id")
    return ledger.usage_buckets(rows, ZONE)


_KEYS = {"day": "strftime(to_timestamp(us / 1e6) AT TIME ZONE 'Asia/Shanghai', '%Y-%m-%d')", "model": "l.model", "machine": "u.machine_id", "project": "coalesce(nullif(u.project, ''), '(unknown)')", "session": "coalesce(nullif(u.session_id, ''), '(unknown)')", "total": "NULL"}
_add(
    "ledger_buckets",
    _buckets,
    f"WITH {_LEDGER}, b AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS dimension, CAST({key.replace('us /', 'l.us /')} AS VARCHAR) AS key, l.* FROM ledger l JOIN usage u USING (event_id)" for name, key in _KEYS.items())
    + """) SELECT dimension, key, count(*) AS events, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(round(sum(cost_usd), 6) AS DOUBLE) AS cost_usd, count(cost_usd) AS priced_events,
  round(sum(i + o) FILTER (cost_usd IS NOT NULL) * 100.0 / sum(i + o), 4) AS coverage_pct FROM b GROUP BY 1, 2""",
)
_add(
    "exclusive_counters",
    lambda spark, sf: ledger.exclusive_counters(uq._ledger(spark, sf)).select("event_id", "uncached_tokens", "cached_tokens", "cache_write_tokens", "output_tokens"),
    f"WITH {_LEDGER} SELECT event_id, greatest(0, i - c - w) AS uncached_tokens, c AS cached_tokens, w AS cache_write_tokens, o AS output_tokens FROM ledger",
)


# --- profiles, titles, boundaries -----------------------------------------------------------------------------


def _profiles(spark, sf):
    """Each profile with its latest request, one row for each profile whether it has requests or not."""
    profiles = spark.createDataFrame([("p0",), ("p1",), ("p9",)], "profile_id string")
    return dedup.with_latest(profiles, synthetic.usage(spark, sf), ["profile_id"], "us", ["event_id", "machine_id", "model", "us"], ["event_id"])


_add(
    "profiles_latest",
    _profiles,
    f"WITH {USAGE_SQL} SELECT p.profile_id, e.event_id, e.machine_id, e.model, e.us FROM (VALUES ('p0'), ('p1'), ('p9')) p(profile_id) LEFT JOIN (SELECT * FROM usage QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY us DESC, event_id DESC) = 1) e USING (profile_id)",
)


def _titled(spark, sf):
    """Sessions with the titles that log lines gave them, forks of one conversation merged."""
    titles = logs.session_titles(raw.title_lines(spark, sf)).select("session_id", F.concat(F.lit("about "), F.length("title") % 3).alias("title"))
    sessions = uq._tokens(spark, sf).groupBy("session_id", "machine_id", F.coalesce("project", F.lit("(unknown)")).alias("project")).agg(F.min("us").alias("first_us"), F.sum("tokens").alias("total_tokens"))
    return u.merge_forks(sessions.join(titles, "session_id", "left"))


_add(
    "titled_sessions",
    _titled,
    f"""WITH {PRICED_SQL}, titles AS ({SOURCE_ORACLES["session_titles"]}), s AS (
  SELECT c.session_id, machine_id, coalesce(project, '(unknown)') AS project, 'about ' || length(t.title) % 3 AS title, min(us) AS f, sum(tokens) AS t FROM counted c LEFT JOIN titles t ON t.session_id = c.session_id GROUP BY ALL
) SELECT title, project, machine_id, arg_min(session_id, (f, session_id)) AS session_id, count(DISTINCT session_id) AS members, CAST(sum(t) AS BIGINT) AS total_tokens FROM s GROUP BY title, project, machine_id, CASE WHEN title IS NULL THEN session_id END""",
)


def _cut_at(spark, sf):
    """Share of a profile's sessions that one of the quota windows' ends cuts."""
    ends = uq._quota(spark, sf, "five_hour").select("profile_id", F.col("resets_us").alias("boundary_us")).distinct()
    return ordered.session_cuts(uq._tokens(spark, sf), ends)


_add(
    "session_cuts",
    _cut_at,
    f"""WITH {PRICED_SQL}, {QUOTA_SQL}, b AS (SELECT DISTINCT profile_id, resets_us AS b FROM quota WHERE window_kind = 'five_hour'), s AS (SELECT profile_id, session_id, min(us) AS a, max(us) AS z FROM counted GROUP BY ALL),
c AS (SELECT s.*, EXISTS (SELECT 1 FROM b WHERE b.profile_id = s.profile_id AND s.a < b.b AND b.b < s.z) AS cut FROM s) SELECT profile_id, count(*) AS sessions, count(*) FILTER (cut) AS cut_sessions, round(avg(CASE WHEN cut THEN 1.0 ELSE 0 END), 6) AS cut_rate FROM c GROUP BY 1""",
)


def _families(spark, sf):
    """What counts in a window scoped to a model family: requests and tokens of the family in the seven days before now."""
    kinds = spark.createDataFrame([("seven_day_fable",), ("seven_day_Opus",), ("seven_day_scoped",), ("seven_day",), ("five_hour",)], "window_kind string")
    named = kinds.withColumn("family", presentation.window_family(F.col("window_kind")))
    since = uq._now(spark, sf) - 7 * 24 * ordered.HOUR_US
    recent = synthetic.usage(spark, sf).where(counts_toward_quota() & (F.col("us") >= since)).groupBy("profile_id", "model").agg(F.count("*").alias("events"), F.sum(quota_tokens()).alias("tokens"))
    # A few models meet a few kinds: one small row for each.
    met = recent.join(named, F.col("family").isNull() | presentation.model_in_family(F.col("model"), F.col("family")))
    return met.groupBy("profile_id", "window_kind", "family").agg(F.sum("events").alias("events"), F.sum("tokens").alias("tokens"))


_add(
    "family_windows",
    _families,
    f"""WITH {PRICED_SQL}, now AS (SELECT max(epoch_us(ts)) AS n FROM events), k AS (SELECT * FROM (VALUES ('seven_day_fable', 'fable'), ('seven_day_Opus', 'opus'), ('seven_day_scoped', NULL), ('seven_day', NULL), ('five_hour', NULL)) k(window_kind, family))
SELECT profile_id, window_kind, family, count(*) AS events, CAST(sum(tokens) AS BIGINT) AS tokens FROM counted, now, k WHERE us >= n - 604800000000 AND (family IS NULL OR model LIKE 'claude-' || family || '-%') GROUP BY ALL""",
)


def _appended(spark, sf):
    """Quota samples appended twice over: what comes again, and what comes twice in one batch, is there once."""
    q = synthetic.quota(spark, sf, arrival=True)
    keys = ["profile_id", "window_kind", "us"]
    split = 17 * ordered.HOUR_US
    stored = q.where(F.floor(F.col("us") / split) % 2 == 0)
    incoming = q.unionByName(q.where(F.floor(F.col("us") / split) % 3 == 0))
    return dedup.append_new(stored, incoming, keys, ["event_id"]).groupBy("profile_id", "window_kind").agg(F.count("*").alias("samples"), F.countDistinct("us").alias("moments"), F.round(F.sum("pct"), 4).alias("points"))


_add("snapshots_appended", _appended, f"WITH {QUOTA_SQL}, o AS (SELECT DISTINCT ON (profile_id, window_kind, us) * FROM quota) SELECT profile_id, window_kind, count(*) AS samples, count(DISTINCT us) AS moments, round(sum(pct), 4) AS points FROM o GROUP BY 1, 2")
