"""Raw feeds derived from the driver's events: log lines, payloads and transport lines, good and bad ones mixed by event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.functions.json_values import once
from meterlark.sources import synthetic


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events dealt to all cores: a row of some bytes becomes a line of a kilobyte, so a file for one task is work for many."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").repartition("event_id")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log line for each event: path, pos, value.

    By event_id % 20: 0 no JSON, 1 another type, 2 no usage, 3 no time, 4 no split of cache writes, 5 a wrong sum,
    7 a count in quotes and one below zero, 8 iterations null, 9 a stop reason, 11 blank.
    """
    u = synthetic.requests_of(_table(spark, sf_dir)).withColumn("r", F.col("event_id") % 20)
    total = F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens")
    part = lambda condition, text: F.when(condition, text).otherwise("")
    usage = F.concat(
        F.lit('{"input_tokens":'), F.when(F.col("r") == 7, F.concat(F.lit('"'), "input_tokens", F.lit('"'))).otherwise(F.col("input_tokens").cast("string")),
        F.lit(',"output_tokens":'), F.when(F.col("r") == 7, F.lit("-1")).otherwise(F.col("output_tokens").cast("string")),
        F.lit(',"cache_read_input_tokens":'), "cache_read_tokens",
        F.lit(',"cache_creation_input_tokens":'), total + F.when(F.col("r") == 5, 1).otherwise(0),
        part(F.col("r") != 4, F.concat(F.lit(',"cache_creation":{"ephemeral_5m_input_tokens":'), "cache_write_5m_tokens", F.lit(',"ephemeral_1h_input_tokens":'), "cache_write_1h_tokens", F.lit("}"))),
        F.lit(',"output_tokens_details":{"thinking_tokens":'), "thinking_tokens", F.lit('},"service_tier":"standard"'),
        part(F.col("r") == 8, F.lit(',"iterations":null')), F.lit("}"),
    )
    value = F.concat(
        F.lit('{"type":"'), F.when(F.col("r") == 1, "user").otherwise("assistant"), F.lit('","timestamp":"'), F.when(F.col("r") == 3, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
        F.lit('","sessionId":"'), "session_id", F.lit('"'), part(F.col("request_id") != "", F.concat(F.lit(',"requestId":"'), "request_id", F.lit('"'))),
        part(F.col("event_id") % 3 == 0, F.lit(',"gitBranch":"main"')), part(F.col("event_id") % 2 == 0, F.lit(',"entrypoint":"cli"')), part(F.col("event_id") % 7 == 0, F.lit(',"isSidechain":true')),
        F.lit(',"message":{"id":"'), "message_id", F.lit('","model":"'), "model", F.lit('"'), part(F.col("r") == 9, F.lit(',"stop_reason":"end_turn"')),
        part(F.col("r") != 2, F.concat(F.lit(',"usage":'), usage)), F.lit("}}"),
    )
    path = F.when(F.col("project").isNull(), F.concat(F.lit("/logs/other/"), "session_id", F.lit(".jsonl"))).otherwise(F.concat(F.lit("/logs/projects/"), "project", F.lit("/"), "session_id", F.lit(".jsonl")))
    shown = F.when(F.col("r") == 0, F.substring(value, 1, 30)).when(F.col("r") == 11, "  ").otherwise(value)
    return once(u.select(path.alias("path"), F.struct(F.lit(0).cast("long").alias("start"), F.col("event_id").alias("row")).alias("pos"), shown.alias("value")))


LOG_SQL = (
    synthetic.USAGE_SQL
    + """, log AS (
  SELECT event_id, CASE WHEN project IS NULL THEN '/logs/other/' || session_id || '.jsonl' ELSE '/logs/projects/' || project || '/' || session_id || '.jsonl' END AS path, message_id, request_id, session_id, model, us // 1000 * 1000 AS us,
    CASE WHEN event_id % 20 = 7 THEN 0 ELSE input_tokens END AS input_tokens, CASE WHEN event_id % 20 = 7 THEN 0 ELSE output_tokens END AS output_tokens, cache_read_tokens,
    CASE WHEN event_id % 20 = 4 THEN cache_write_5m_tokens + cache_write_1h_tokens ELSE cache_write_5m_tokens END AS cache_write_5m_tokens, CASE WHEN event_id % 20 = 4 THEN 0 ELSE cache_write_1h_tokens END AS cache_write_1h_tokens,
    thinking_tokens, coalesce(project, 'other') AS project, CASE WHEN event_id % 3 = 0 THEN 'main' END AS git_branch, CASE WHEN event_id % 2 = 0 THEN 'cli' END AS entrypoint, 'standard' AS service_tier,
    event_id % 7 = 0 AS is_sidechain, event_id % 20 IN (8, 9) AS output_final, event_id % 20 = 5 AND true AS wrong_sum,
    CASE WHEN event_id % 20 IN (0, 1, 2, 11) THEN 0 WHEN event_id % 20 = 3 THEN 1 ELSE 2 END AS state,
    cache_write_5m_tokens + cache_write_1h_tokens AS total
  FROM usage
), requests AS (
  SELECT *, left(sha256(concat_ws('|', session_id, us // 1000, model, input_tokens, output_tokens, cache_read_tokens, cache_write_5m_tokens, cache_write_1h_tokens)), 32) AS semantic_id FROM log WHERE state = 2
)"""
)


def title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title line for one event in five: a user's own (event_id % 10 = 0) or an agent's (5), some empty, some long."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 5 = 0")
    own = F.col("event_id") % 10 == 0
    title = F.when(F.col("event_id") % 30 == 0, F.lit("  ")).otherwise(F.concat(F.lit("  Title   no "), F.col("event_id"), F.when(F.col("event_id") % 20 == 5, F.repeat(F.lit(" é"), 100)).otherwise("\\t ")))
    value = F.concat(F.lit('{"type":"'), F.when(own, "custom-title").otherwise("agent-name"), F.lit('","sessionId":"s'), F.col("user_id"), F.lit('","'), F.when(own, "customTitle").otherwise("agentName"), F.lit('":"'), title, F.lit('"}'))
    return e.where("user_id % 3 <> 1 OR event_id % 10 = 5").select(F.lit("/logs/projects/a/all.jsonl").alias("path"), F.struct(F.lit(0).cast("long").alias("start"), F.col("event_id").alias("row")).alias("pos"), value.alias("value"))


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir)
    return e.select("event_id", "user_id", _k().alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), (F.unix_seconds(F.col("ts").cast("timestamp"))).alias("s"))


def quota_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage responses by event_id % 4: flat, with limits, with empty limits, and no JSON."""
    e = _events(spark, sf_dir)
    flat = F.format_string('{"five_hour":{"utilization_pct":%d,"resets_at":"%s"},"seven_day":{"utilization":%d.5,"reset_at":%d},"extra_usage":{"limit":5},"note":"x"}', "k", "iso", "k", "s")
    limits = F.format_string('{"seven_day":{"utilization":1},"limits":[{"kind":"session","percent":%d,"resetsAt":%d},{"kind":"weekly_all","percent":%d,"resets_at":null},{"kind":"weekly_scoped","percent":1,"scope":{"model":{"display_name":" Fable 5 "}}},{"kind":"weekly_scoped","percent":2},{"kind":"odd","percent":"9"},7]}', "k", F.col("s") * 1000, "k")
    empty = F.format_string('{"limits":[],"five_hour":{"utilizationPct":%d},"seven_day":{"utilization":"80"},"odd":{"utilization":null,"utilization_pct":null}}', "k")
    return once(e.select("event_id", F.when(F.col("event_id") % 4 == 0, flat).when(F.col("event_id") % 4 == 1, limits).when(F.col("event_id") % 4 == 2, empty).otherwise("{nothing").alias("raw")))


def breakdown_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    inner = F.format_string('{"as_of":"%s","window_started_at":null,"rows":[{"key":"claude_code","display_name":"Code","percent":%d},{"key":"chat","display_name":"","percent":%d},{"key":"","percent":1},{"key":"x","percent":"2"},5]}', "iso", 100 - F.col("k"), "k")
    return e.select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"seven_day_breakdown":'), inner, F.lit("}"))).when(F.col("event_id") % 3 == 1, inner).otherwise('{"seven_day_breakdown":null,"rows":[{"key":"a","percent":1}]}').alias("raw"))


def organisation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    one = F.format_string('[{"uuid":"o%d","name":"Team","rate_limit_tier":"default_raven","capabilities":["chat","raven",3]}]', "event_id")
    two = F.format_string('[{"id":"a%d","rate_limit_tier":"default_claude_max_5x","capabilities":["claude_max"]},{"uuid":null,"id":"b%d","name":"Own","rate_limit_tier":"","capabilities":"no"},{"name":"none"},4]', "event_id", "event_id")
    both = F.format_string('[{"uuid":"c%d","rate_limit_tier":"raven_x","capabilities":["raven"]},{"uuid":"d%d","rate_limit_tier":"default_pro","capabilities":["claude_pro"]}]', "event_id", "event_id")
    return e.select("event_id", F.when(F.col("event_id") % 4 == 0, one).when(F.col("event_id") % 4 == 1, two).when(F.col("event_id") % 4 == 2, both).otherwise('{"uuid":"x"}').alias("raw"))


def ledger_web_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    body = F.format_string('{"plan_type":"pro","rate_limit":{"primary_window":{"used_percent":%d,"limit_window_seconds":18001,"reset_at":%d},"secondary_window":%s},"additional_rate_limits":[{"metered_feature":"big model*","limit_name":"Big","rate_limit":{"primary_window":{"used_percent":3.5,"limit_window_seconds":0,"reset_at":0}}},{"limit_name":"no id"},null]}', F.when(F.col("event_id") % 3 == 2, 101).otherwise(F.col("k")), "s", F.when(F.col("event_id") % 2 == 0, F.lit("null")).otherwise('{"used_percent":7}'))
    return e.select("event_id", body.alias("raw"))


def ledger_client_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    by_id = F.format_string('{"rateLimitsByLimitId":{"codex":{"primary":{"usedPercent":%d,"windowDurationMins":300,"resetsAt":%d},"secondary":null,"limitName":"Main"}},"rateLimits":{"primary":{"usedPercent":99}}}', "k", "s")
    older = F.format_string('{"rateLimits":{"primary":{"usedPercent":%d,"windowDurationMins":0},"secondary":{"usedPercent":%d}}}', "k", F.when(F.col("k") > 90, -1).otherwise(2))
    return e.select("event_id", F.when(F.col("event_id") % 3 == 0, by_id).when(F.col("event_id") % 3 == 1, older).otherwise('{"rateLimitsByLimitId":{},"rateLimits":{"primary":{"usedPercent":5}}}').alias("raw"))


def account_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    good = F.format_string('{"summary":{"lifetimeTokens":%d},"dailyUsageBuckets":[{"startDate":"%s","tokens":%d},{"startDate":"2026-01-01","tokens":0}]}', F.col("event_id") * 10, F.substring("iso", 1, 10), "k")
    bad = F.format_string('{"summary":{"lifetimeTokens":1},"dailyUsageBuckets":[{"startDate":"%s","tokens":-1}]}', F.substring("iso", 1, 10))
    return e.select("event_id", F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, '{"summary":{"lifetimeTokens":null},"dailyUsageBuckets":null}').otherwise(bad).alias("raw"))


def transport_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """usage with all columns that the transport format has."""
    u = synthetic.requests_of(_table(spark, sf_dir))
    from meterlark.functions.scalars import semantic_id

    return u.withColumns({
        "semantic_id": semantic_id(), "app_type": F.lit("claude"), "git_branch": F.when(F.col("event_id") % 3 == 0, "main"), "entrypoint": F.lit("cli"), "service_tier": F.lit(None).cast("string"),
        "is_sidechain": F.col("event_id") % 7 == 0, "backfill": F.lit(False), "us": F.floor(F.col("us") / 1000) * 1000,
    })


def transport_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded events as lines(event_id, value), some spoiled by event_id % 25: 1 no JSON, 2 a negative count, 3 no machine, 4 no time, 5 a count in quotes, 6 blank, 7 an unknown level."""
    from meterlark.sources.wire import encode_events, json_line

    events = transport_events(spark, sf_dir)
    wire = encode_events(events.where("event_id IS NOT NULL"))
    event_id = F.substring("message_id", 5, 20).cast("long")
    r = F.col("event_id") % 25
    # One encoding and one pass over it: what is replaced, and by what, is chosen for each line.
    replaced = {2: ('"output_tokens":', '"output_tokens":-1'), 3: ('"machine_id":"[^"]*"', '"machine_id":""'), 4: ('"ts":"[^"]*"', '"ts":"never"'), 5: (r'"input_tokens":(\d+)', '"input_tokens":"$1"'), 7: ('"attribution_level":"[^"]*"', '"attribution_level":"guess"')}
    pattern, by = F.lit("(?!)"), F.lit("")
    for kind, (found, put) in replaced.items():
        pattern, by = F.when(r == kind, found).otherwise(pattern), F.when(r == kind, put).otherwise(by)
    spoiled = F.when(r == 6, "  ").otherwise(F.substring(F.regexp_replace(F.col("line"), pattern, by), F.lit(1), F.when(r == 1, 20).otherwise(1 << 30)))
    return once(wire.select(event_id.alias("event_id"), json_line(wire).alias("line")).select("event_id", spoiled.alias("value")))


def snapshot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    good = F.format_string('{"profile_id":"p%d","captured_at":"%s","windows":[{"window_kind":"five_hour","utilization_pct":%d,"resets_at":"%s"},{"window_kind":"seven_day","utilization_pct":null}],"raw":{}}', F.col("user_id") % 2, "iso", "k", "iso")
    bad = F.format_string('{"profile_id":"p1","captured_at":"%s","windows":[{"window_kind":"five_hour","utilization_pct":101}]}', "iso")
    return e.select(F.when(F.col("event_id") % 5 == 0, bad).when(F.col("event_id") % 5 == 1, "{").otherwise(good).alias("value"))


def rollout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session file of the second ledger for each user: path, pos, value.

    After its header and its context each event reports totals and its own usage. By event_id: every 7th lets the totals
    grow by 5 more, every 10th comes twice, and before every 10th other one stands a line that is no JSON.
    """
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, us = F.get_json_object("props", "$.k").cast("long"), F.unix_micros(F.col("ts").cast("timestamp"))
    own = e.select("event_id", "user_id", us.alias("us"), (k + 1).alias("i"), F.floor(F.col("value") * 10).alias("o"), F.when(F.col("event_id") % 7 == 0, 5).otherwise(0).alias("x"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = own.withColumns({"ti": F.sum(F.col("i") + F.col("x")).over(w), "to": F.sum("o").over(w), "n": F.row_number().over(w)})
    usage = lambda i, o: F.format_string('{"input_tokens":%d,"cached_input_tokens":0,"cache_write_input_tokens":0,"output_tokens":%d,"reasoning_output_tokens":0,"total_tokens":%d}', i, o, i + o)
    count = F.format_string('{"type":"event_msg","timestamp":"%s","payload":{"type":"token_count","info":{"total_token_usage":%s,"last_token_usage":%s}}}', "iso", usage(F.col("ti"), F.col("to")), usage(F.col("i"), F.col("o")))
    at = lambda step: F.col("n").cast("long") * 4 + step
    line = lambda pos, value: F.struct(pos.alias("pos"), value.alias("value"))
    head = F.array(line(F.lit(0).cast("long"), F.format_string('{"type":"session_meta","timestamp":"%s","payload":{"id":"s%d","cwd":"/w/%d","model_provider":"p"}}', "iso", "user_id", "user_id")), line(F.lit(1).cast("long"), F.format_string('{"type":"turn_context","payload":{"turn_id":"t%d","model":"gpt-a","effort":"high"}}', "user_id")))
    none = F.array().cast("array<struct<pos:bigint,value:string>>")
    bad = F.when(F.col("event_id") % 10 == 4, F.array(line(at(0), F.lit('{"type":')))).otherwise(none)
    again = F.when(F.col("event_id") % 10 == 3, F.array(line(at(2), F.col("count")))).otherwise(none)
    every = F.concat(F.when(F.col("n") == 1, head).otherwise(none), bad, F.array(line(at(1), F.col("count"))), again)
    counted = summed.withColumn("count", count)
    return counted.select(F.format_string("/rollouts/s%d.jsonl", "user_id").alias("path"), F.explode(every).alias("l")).select("path", "l.pos", "l.value")
