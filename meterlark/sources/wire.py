"""The transport format: events and snapshots as JSON lines, in both directions, and the sinks that take them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.functions import json_values as jv
from meterlark.functions.scalars import TOKEN_PARTS, semantic_id
from meterlark.sources.shared import written

COUNTS = (*TOKEN_PARTS, "thinking_tokens")
REQUIRED = ("message_id", "machine_id", "profile_id", "ts")
TEXTS = ("request_id", "model", "session_id")
#: Lines that one task sorts when they are dealt into batches.
RANGE_LINES = 100_000
OPTIONAL = ("project", "git_branch", "entrypoint", "service_tier")
_NAMES = {"project": "project_slug"}
EVENT = ("message_id", "request_id", "semantic_id", "machine_id", "app_type", "profile_id", "attribution_level", "us", "model", *TOKEN_PARTS, "thinking_tokens", "session_id", *OPTIONAL, "is_sidechain", "output_final", "backfill")


_TEXT = (*REQUIRED, *TEXTS, "semantic_id", "app_type", "attribution_level")
_LINE = ", ".join([f"{c} variant" for c in (*_TEXT, *(_NAMES.get(c, c) for c in OPTIONAL), "is_sidechain", "backfill", "output_final")] + [f"{c} string" for c in COUNTS])


def _coerced_count(value: Column) -> Column:
    """A whole number not below zero; absent or null is 0, numbers in quotes and booleans count, anything else is null."""
    shown = F.trim(value)
    n = F.when(value.isNull() | (shown == ""), F.lit(0.0)).when(shown == "true", 1.0).when(shown == "false", 0.0).otherwise(shown.try_cast("double"))
    return F.when((n >= 0) & (n == F.floor(n)) & (n < 9.0e18), n.cast("long"))


def _decoded(lines: DataFrame) -> DataFrame:
    """lines(value, ...) with the columns of an event and `_good`, whether the line is one; blank lines are left out."""
    keep = [c for c in lines.columns if c != "value"]
    d = lambda c: F.col(f"_d.{c}")
    read = jv.once(lines.where(F.trim("value") != "").select(*keep, jv.read(F.trim("value"), _LINE).alias("_d")))
    # Fields of a kind are read as one array: written out one by one they make a method beyond 8,000 bytes of code,
    # which the JVM never compiles.
    texts = ("message_id", "machine_id", "profile_id", *TEXTS, *OPTIONAL, "ts", "app_type", "attribution_level", "semantic_id")
    plain = F.forall(F.array(*[d(c) for c in (*TEXTS, "app_type", "attribution_level", "semantic_id")]), lambda v: v.isNull() | (F.schema_of_variant(v) == "STRING"))  # absent is fine, another type is not
    typed = jv.once(read.select(
        *keep,
        F.transform(F.array(*[d(_NAMES.get(c, c)) for c in texts]), jv.text).alias("_t"),
        F.transform(F.array(*[d(c) for c in COUNTS]), _coerced_count).alias("_n"),
        *[jv.boolean(d(c)).alias(c) for c in ("is_sidechain", "backfill", "output_final")],
        plain.alias("_typed"),
    ))
    t = lambda c: F.col("_t")[texts.index(c)]
    one_of = lambda c, known, other: F.when(t(c).isin(*known), t(c)).otherwise(other).alias(c)
    out = jv.once(typed.select(
        *keep,
        *[F.coalesce(t(c), F.lit("")).alias(c) for c in ("message_id", "machine_id", "profile_id", *TEXTS)],
        *[F.col("_n")[i].alias(c) for i, c in enumerate(COUNTS)],
        *[t(c).alias(c) for c in OPTIONAL],
        (F.floor(jv.moment_us(t("ts")) / 1000) * 1000).alias("us"),
        one_of("app_type", ("codex", "gemini"), "claude"),
        one_of("attribution_level", ("proxy", "timeline", "fallback"), "unknown"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("is_sidechain", "backfill")],
        "output_final",
        "_typed",
        F.nullif(t("semantic_id"), F.lit("")).alias("_sent"),
    ))
    filled = F.col("_typed") & F.col("us").isNotNull() & (F.col("message_id") != "") & (F.col("machine_id") != "") & (F.col("profile_id") != "")
    for c in COUNTS:
        filled = filled & F.col(c).isNotNull()
    return out.withColumns({"semantic_id": F.coalesce("_sent", semantic_id()), "_good": F.coalesce(filled, F.lit(False))}).select(*keep, *EVENT, "_good")


def decode_events(lines: DataFrame) -> DataFrame:
    """lines(value, ...) with `event`, null where the line is invalid, and `invalid`; blank lines are left out.

    An invalid line is counted and left out; it never refuses the batch around it.
    """
    keep = [c for c in lines.columns if c != "value"]
    return _decoded(lines).select(*keep, F.when(F.col("_good"), F.struct(*EVENT)).alias("event"), (~F.col("_good")).alias("invalid"))


def accepted_events(lines: DataFrame) -> DataFrame:
    """The events of the valid lines, beside the other columns of lines."""
    return _decoded(lines).where("_good").drop("_good")


def ingest_counts(lines: DataFrame) -> DataFrame:
    """By profile: events accepted and the time of the last; invalid lines count under a null profile."""
    good = F.col("_good")
    marked = _decoded(lines).select(F.when(good, F.col("profile_id")).alias("profile_id"), F.when(good, F.col("us")).alias("us"), "_good")
    return marked.groupBy("profile_id").agg(F.count_if("_good").alias("events"), F.count_if(~good).alias("invalid"), F.max("us").alias("last_us"))


def decode_snapshots(lines: DataFrame) -> DataFrame:
    """One row for each window of quota snapshots in lines(value): profile_id, machine_id, us, window_kind, pct (absent is 0), resets_us."""
    w = F.col("_w")
    read = lines.select(jv.read(F.trim("value"), "profile_id variant, machine_id variant, captured_at variant, windows array<struct<window_kind:variant,utilization_pct:double,resets_at:variant>>").alias("_d"))
    flat = read.select(jv.full_text(F.col("_d.profile_id")).alias("profile_id"), jv.text(F.col("_d.machine_id")).alias("machine_id"), jv.moment_us(jv.text(F.col("_d.captured_at"))).alias("us"), F.col("_d.windows").alias("_all"))
    fit = F.forall("_all", lambda x: jv.full_text(x["window_kind"]).isNotNull() & F.coalesce(x["utilization_pct"].between(0, 100), F.lit(True)))
    each = flat.where(F.col("profile_id").isNotNull() & F.col("us").isNotNull() & fit).withColumn("_w", F.explode("_all"))
    return each.select("profile_id", "machine_id", "us", jv.text(w["window_kind"]).alias("window_kind"), F.coalesce(w["utilization_pct"], F.lit(0.0)).alias("pct"), jv.moment_us(jv.text(w["resets_at"])).alias("resets_us"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text in lowercase hex, from two plain digests."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def hashed_project(project: Column, secret: str) -> Column:
    """The name a project gets outside: `h_` and 24 digits of a keyed digest."""
    return F.concat(F.lit("h_"), F.substring(hmac_sha256(secret.encode(), project), 1, 24))


def encode_events(events: DataFrame, secret: str | None = None) -> DataFrame:
    """events as transport objects, listed fields only; ids that are missing are replaced by the semantic id."""
    slug = F.col("project") if not secret else F.when(F.col("project") == "", F.col("project")).otherwise(hashed_project(F.col("project"), secret))
    id_of = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("semantic_id"))
    columns = {"message_id": id_of("message_id"), "request_id": id_of("request_id"), "project_slug": slug, "ts": F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")}
    names = ["message_id", "request_id", "semantic_id", "machine_id", "app_type", "profile_id", "attribution_level", "ts", "model", *COUNTS, "session_id", "project_slug", "git_branch", "entrypoint", "service_tier", "is_sidechain", "output_final", "backfill"]
    return events.select(*[columns.get(n, F.col(n)).alias(n) for n in names])


def json_line(wire: DataFrame) -> Column:
    return F.to_json(F.struct(*wire.columns), {"ignoreNullFields": "false"})


def batches(wire: DataFrame, keys: list[str], rows: int = 1000) -> DataFrame:
    """(keys, batch, body, idempotency_key): transport bodies of at most `rows` lines; the key is the digest of the body."""
    from pyspark.sql import Window

    # A key may hold most lines: they are numbered in ranges of the order, and a range starts where those before it end.
    ranges = wire.count() // RANGE_LINES + 1
    ranged = wire.withColumn("_line", json_line(wire)).repartitionByRange(ranges, *keys, "_line").withColumn("_range", F.spark_partition_id())
    cut = written(ranged.drop("_line"), "line-ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    lines = cut.select(*keys, "_range", json_line(cut.select(*wire.columns)).alias("_line"))
    placed = lines.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_line")))
    joined = placed.join(starts, [*keys, "_range"])
    numbered = joined.withColumn("batch", F.floor((F.col("_start") + F.col("_i") - 1) / rows))
    body = F.concat(F.array_join(F.array_sort(F.collect_list("_line")), "\n"), F.lit("\n"))
    return numbered.groupBy(*keys, "batch").agg(body.alias("body")).withColumn("idempotency_key", F.substring(F.sha2("body", 256), 1, 32))


def write_ndjson(wire: DataFrame, path: str) -> None:
    """Compressed JSON lines, nulls written out."""
    wire.write.option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def sse_frame(name: str, data: Column) -> Column:
    """A server-sent event of this name with a JSON value."""
    return F.concat(F.lit(f"event: {name}\ndata: "), F.to_json(data), F.lit("\n\n"))
