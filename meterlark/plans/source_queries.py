"""Registered queries over raw feeds, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlark.sources import logs, payloads, raw, synthetic, wire

QUERIES, ORACLES = {}, {}


def _add(name: str, query, sql: str | None = None) -> None:
    query.__name__ = name
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


_TOKENS = "input_tokens, output_tokens, cache_read_tokens, cache_write_5m_tokens, cache_write_1h_tokens, thinking_tokens"
_EVENTS = "ev AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us, epoch_us(ts) // 1000 * 1000 AS ms, epoch_us(ts) // 1000000 AS s, ts FROM events)"

_add(
    "log_requests",
    lambda spark, sf: logs.requests(raw.log_lines(spark, sf)).drop("pos"),
    f"WITH {raw.LOG_SQL} SELECT path, message_id, request_id, semantic_id, model, us, {_TOKENS}, session_id, project, git_branch, entrypoint, service_tier, is_sidechain, output_final FROM requests",
)
_add(
    "log_warnings",
    lambda spark, sf: logs.parse_requests(raw.log_lines(spark, sf)).where(F.size("warnings") > 0).select(F.col("pos.row").alias("event_id"), F.array_join("warnings", ",").alias("warnings")),
    f"""WITH {raw.LOG_SQL}, w AS (
  SELECT event_id, concat_ws(',', CASE WHEN state = 1 THEN 'bad-timestamp' END, CASE WHEN state = 2 AND wrong_sum THEN 'cache-sum-mismatch' END,
    CASE WHEN state = 2 AND event_id % 20 = 4 AND total > 0 THEN 'missing-cache-breakdown' END, CASE WHEN state = 2 AND request_id = '' THEN 'missing-request-id' END) AS warnings FROM log
) SELECT * FROM w WHERE warnings <> ''""",
)
_add(
    "log_statistics",
    lambda spark, sf: logs.parse_statistics(raw.log_lines(spark, sf)),
    f"""WITH {raw.LOG_SQL} SELECT 'lines' AS kind, CASE WHEN state = 2 THEN 'event' ELSE 'other' END AS key, count(*) AS n FROM log GROUP BY 1, 2
UNION ALL SELECT 'warning', 'bad-timestamp', count(*) FROM log WHERE state = 1 HAVING count(*) > 0
UNION ALL SELECT 'warning', 'cache-sum-mismatch', count(*) FROM log WHERE state = 2 AND wrong_sum HAVING count(*) > 0
UNION ALL SELECT 'warning', 'missing-cache-breakdown', count(*) FROM log WHERE state = 2 AND event_id % 20 = 4 AND total > 0 HAVING count(*) > 0
UNION ALL SELECT 'warning', 'missing-request-id', count(*) FROM log WHERE state = 2 AND request_id = '' HAVING count(*) > 0
UNION ALL SELECT 'model', model, count(*) FROM requests GROUP BY 2
UNION ALL SELECT 'entrypoint', coalesce(entrypoint, '(none)'), count(*) FROM requests GROUP BY 2""",
)
_add(
    "session_titles",
    lambda spark, sf: logs.session_titles(raw.title_lines(spark, sf)),
    """WITH t AS (
  SELECT 's' || user_id AS session_id, event_id, event_id % 10 = 0 AS own, left(trim('Title no ' || event_id || CASE WHEN event_id % 20 = 5 THEN repeat(' é', 100) ELSE '' END), 120) AS title
  FROM events WHERE event_id % 5 = 0 AND (user_id % 3 <> 1 OR event_id % 10 = 5) AND event_id % 30 <> 0
) SELECT session_id, arg_max(title, (own, event_id)) AS title, CASE WHEN bool_or(own) THEN 'custom' ELSE 'agent' END AS kind FROM t GROUP BY 1""",
)


def _title_upsert(spark, sf):
    """Agents' titles stored first, then everything that comes: titles that change take the new time."""
    titles = raw.title_lines(spark, sf)
    timed = logs.session_titles(titles.where("pos.row % 10 = 5")).select("session_id", "title", F.lit(1).cast("long").alias("updated_us"))
    return logs.upsert_titles(timed, logs.session_titles(titles).select("session_id", "title", F.lit(2).cast("long").alias("updated_us")))


_add(
    "title_upsert",
    _title_upsert,
    """WITH t AS (
  SELECT 's' || user_id AS session_id, event_id, event_id % 10 = 0 AS own, left(trim('Title no ' || event_id || CASE WHEN event_id % 20 = 5 THEN repeat(' é', 100) ELSE '' END), 120) AS title
  FROM events WHERE event_id % 5 = 0 AND (user_id % 3 <> 1 OR event_id % 10 = 5) AND event_id % 30 <> 0
), a AS (SELECT session_id, arg_max(title, event_id) AS title FROM t WHERE NOT own GROUP BY 1), b AS (SELECT session_id, arg_max(title, (own, event_id)) AS title FROM t GROUP BY 1)
SELECT session_id, b.title, CAST(CASE WHEN a.title = b.title THEN 1 ELSE 2 END AS BIGINT) AS updated_us FROM b LEFT JOIN a USING (session_id)""",
)
_add(
    "payload_windows",
    lambda spark, sf: payloads.quota_windows(raw.quota_responses(spark, sf)),
    f"""WITH {_EVENTS} SELECT event_id, 'five_hour' AS window_kind, CAST(k AS DOUBLE) AS pct, ms AS resets_us FROM ev WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 'seven_day', k + 0.5, s * 1000000 FROM ev WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 'five_hour', k, s * 1000000 FROM ev WHERE event_id % 4 = 1 UNION ALL SELECT event_id, 'seven_day', k, NULL FROM ev WHERE event_id % 4 = 1
UNION ALL SELECT event_id, 'seven_day_fable_5', 1, NULL FROM ev WHERE event_id % 4 = 1 UNION ALL SELECT event_id, 'seven_day_scoped', 2, NULL FROM ev WHERE event_id % 4 = 1
UNION ALL SELECT event_id, 'five_hour', k, NULL FROM ev WHERE event_id % 4 = 2""",
)
_add(
    "payload_breakdown",
    lambda spark, sf: payloads.product_breakdown(raw.breakdown_responses(spark, sf)),
    f"""WITH {_EVENTS} SELECT event_id, ms AS as_of_us, CAST(NULL AS BIGINT) AS window_started_us, 'claude_code' AS key, 'Code' AS label, CAST(100 - k AS DOUBLE) AS share_pct FROM ev WHERE event_id % 3 <> 2
UNION ALL SELECT event_id, ms, NULL, 'chat', 'chat', k FROM ev WHERE event_id % 3 <> 2""",
)
_add(
    "payload_organisations",
    lambda spark, sf: payloads.organisations(raw.organisation_lists(spark, sf)).withColumn("capabilities", F.array_join("capabilities", ",")),
    """SELECT event_id, 'o' || event_id AS org_id, 'Team' AS name, 'team' AS plan, 'chat,raven' AS capabilities, true AS unambiguous FROM events WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 'a' || event_id, '', 'max_5x', 'claude_max', true FROM events WHERE event_id % 4 = 1 UNION ALL SELECT event_id, 'b' || event_id, 'Own', NULL, '', false FROM events WHERE event_id % 4 = 1
UNION ALL SELECT event_id, 'c' || event_id, '', 'team', 'raven', false FROM events WHERE event_id % 4 = 2 UNION ALL SELECT event_id, 'd' || event_id, '', 'pro', 'claude_pro', false FROM events WHERE event_id % 4 = 2""",
)
_add(
    "ledger_payload_web",
    lambda spark, sf: payloads.ledger_windows_web(raw.ledger_web_responses(spark, sf)),
    f"""WITH {_EVENTS}, g AS (SELECT * FROM ev WHERE event_id % 3 <> 2)
SELECT event_id, 'codex:primary' AS window_id, 'codex' AS limit_id, CAST(NULL AS VARCHAR) AS label, 'primary' AS slot, CAST(k AS DOUBLE) AS pct, CAST(301 AS BIGINT) AS minutes, s * 1000000 AS resets_us FROM g
UNION ALL SELECT event_id, 'codex:secondary', 'codex', NULL, 'secondary', 7, NULL, NULL FROM g WHERE event_id % 2 = 1
UNION ALL SELECT event_id, 'big%20model*:primary', 'big model*', 'Big', 'primary', 3.5, NULL, NULL FROM g""",
)
_add(
    "ledger_payload_client",
    lambda spark, sf: payloads.ledger_windows_client(raw.ledger_client_responses(spark, sf)),
    f"""WITH {_EVENTS} SELECT event_id, 'codex:primary' AS window_id, 'codex' AS limit_id, 'Main' AS label, 'primary' AS slot, CAST(k AS DOUBLE) AS pct, CAST(300 AS BIGINT) AS minutes, s * 1000000 AS resets_us FROM ev WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'codex:primary', 'codex', NULL, 'primary', k, NULL, NULL FROM ev WHERE event_id % 3 = 1 AND k <= 90 UNION ALL SELECT event_id, 'codex:secondary', 'codex', NULL, 'secondary', 2, NULL, NULL FROM ev WHERE event_id % 3 = 1 AND k <= 90""",
)
_add(
    "account_usage",
    lambda spark, sf: payloads.account_usage(raw.account_responses(spark, sf)),
    f"""WITH {_EVENTS} SELECT event_id, event_id * 10 AS lifetime_tokens, strftime(ts, '%Y-%m-%d') AS day, k AS tokens FROM ev WHERE event_id % 3 = 0
UNION ALL SELECT event_id, event_id * 10, '2026-01-01', 0 FROM ev WHERE event_id % 3 = 0 UNION ALL SELECT event_id, NULL, NULL, NULL FROM ev WHERE event_id % 3 = 1""",
)
_WIRE_SQL = (
    synthetic.USAGE_SQL
    + f""", sent AS (
  SELECT *, us // 1000 * 1000 AS ms, left(sha256(concat_ws('|', session_id, us // 1000, model, input_tokens, output_tokens, cache_read_tokens, cache_write_5m_tokens, cache_write_1h_tokens)), 32) AS semantic_id FROM usage
), good AS (
  SELECT event_id, message_id, CASE WHEN request_id = '' THEN semantic_id ELSE request_id END AS request_id, semantic_id, machine_id, 'claude' AS app_type, profile_id, CASE WHEN event_id % 25 = 7 THEN 'unknown' ELSE attribution_level END AS attribution_level,
    ms AS us, model, {_TOKENS}, session_id, project, CASE WHEN event_id % 3 = 0 THEN 'main' END AS git_branch, 'cli' AS entrypoint, CAST(NULL AS VARCHAR) AS service_tier, event_id % 7 = 0 AS is_sidechain, output_final, false AS backfill
  FROM sent WHERE event_id % 25 NOT IN (1, 3, 4, 6) AND NOT event_id % 25 = 2
)"""
)
_add("wire_decode", lambda spark, sf: wire.accepted_events(raw.transport_lines(spark, sf)), f"WITH {_WIRE_SQL} SELECT * FROM good")
_add(
    "wire_ingest_counts",
    lambda spark, sf: wire.ingest_counts(raw.transport_lines(spark, sf)),
    f"""WITH {_WIRE_SQL} SELECT profile_id, count(*) AS events, CAST(0 AS BIGINT) AS invalid, max(us) AS last_us FROM good GROUP BY 1
UNION ALL SELECT NULL, 0, count(*), NULL FROM usage WHERE event_id % 25 IN (1, 2, 3, 4)""",
)
_add(
    "wire_snapshots",
    lambda spark, sf: wire.decode_snapshots(raw.snapshot_lines(spark, sf)),
    f"""WITH {_EVENTS}, g AS (SELECT * FROM ev WHERE event_id % 5 > 1) SELECT 'p' || (user_id % 2) AS profile_id, CAST(NULL AS VARCHAR) AS machine_id, ms AS us, 'five_hour' AS window_kind, CAST(k AS DOUBLE) AS pct, ms AS resets_us FROM g
UNION ALL SELECT 'p' || (user_id % 2), NULL, ms, 'seven_day', 0, NULL FROM g""",
)
_add(
    "wire_hashed_projects",
    lambda spark, sf: wire.encode_events(raw.transport_events(spark, sf), secret="pepper").groupBy("project_slug").agg(F.count("*").alias("events")),
    None,
)
_add("wire_batches", lambda spark, sf: wire.batches(wire.encode_events(raw.transport_events(spark, sf)), ["machine_id"]).select("machine_id", "batch", F.length("body").alias("chars"), "idempotency_key"))
_add(
    "project_owners",
    lambda spark, sf: logs.owner_ids(
        spark.read.parquet(f"{sf}/events.parquet").select(
            F.concat(F.lit("/logs/projects/a/s"), "user_id", F.lit(".jsonl")).alias("path"),
            F.struct(F.lit(0).cast("long").alias("start"), F.col("event_id").alias("row")).alias("pos"),
            F.when(F.col("event_id") % 3 == 0, F.format_string('{"ownerOrganizationUuid" : "%08d-abcd", broken', "event_id")).when(F.col("event_id") % 3 == 1, F.format_string('{"ownerAccountUuid":"%08d"}', "event_id")).otherwise('{"ownerAccountUuid":"xyz"}').alias("value"),
        )
    ),
    """SELECT '/logs/projects/a/s' || user_id || '.jsonl' AS path, printf('%08d-abcd', max(event_id) FILTER (event_id % 3 = 0)) AS org_id, printf('%08d', max(event_id) FILTER (event_id % 3 = 1)) AS account_id
FROM events WHERE event_id % 3 <> 2 GROUP BY 1""",
)
