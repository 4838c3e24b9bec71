"""Session logs: discovery of line files, request lines, title lines, and their statistics.

A lines frame has (path, pos, value): pos orders the lines of a file and needs no pass over it (block start, then
row number within the split), so a file of any size is read by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlark.functions import json_values as jv
from meterlark.functions.scalars import TOKEN_PARTS, semantic_id

#: Code points of a title that are kept.
TITLE_CHARS = 120
EVENT_COLUMNS = (
    "message_id", "request_id", "semantic_id", "model", "us", *TOKEN_PARTS, "thinking_tokens", "session_id", "project", "git_branch", "entrypoint", "service_tier", "is_sidechain", "output_final",
)


def existing(spark: SparkSession, roots: Sequence[str]) -> list[str]:
    """Those roots, folders or single files, that are there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    return [r for r in roots if path(r).getFileSystem(conf).exists(path(r))]


def read_lines(spark: SparkSession, roots: Sequence[str], glob: str = "*.jsonl") -> DataFrame:
    """The lines of all files under the roots; missing roots are skipped, gzip files are unpacked by name."""
    found = existing(spark, roots)
    if not found:
        return spark.createDataFrame([], "path string, pos struct<start: bigint, row: bigint>, value string")
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(found)
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias("pos"),
        F.regexp_replace("value", "\r$", "").alias("value"),
    )


def project_of(path: Column) -> Column:
    """The project a log file belongs to: the folder below `projects`, else the folder that holds the file."""
    named = F.regexp_extract(path, "/projects/([^/]+)/", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(F.element_at(F.split(path, "/"), -2), F.lit("")))


_USAGE = (
    "input_tokens double, output_tokens double, cache_read_input_tokens double, cache_creation_input_tokens double, service_tier variant, iterations variant, "
    "cache_creation struct<ephemeral_5m_input_tokens:double,ephemeral_1h_input_tokens:double>, output_tokens_details struct<thinking_tokens:double>"
)
_LINE = f"type variant, timestamp variant, requestId variant, sessionId variant, gitBranch variant, entrypoint variant, isSidechain variant, message struct<id:variant,model:variant,stop_reason:variant,usage:struct<{_USAGE.replace(' double', ':double').replace(' variant', ':variant').replace(' struct', ':struct').replace(', ', ',')}>>"


def _parsed(lines: DataFrame) -> DataFrame:
    """lines with the columns of an event, `_good` (whether the line is one) and warnings."""
    usage = F.col("_d.message.usage")
    text = lambda c: F.coalesce(jv.text(F.col(f"_d.{c}")), F.lit(""))
    split = usage["cache_creation"].isNotNull()
    total = jv.count(usage["cache_creation_input_tokens"])
    read = jv.once(jv.once(lines.select("path", "pos", jv.read(F.trim("value"), _LINE).alias("_d"))).select(
        "path", "pos",
        (F.coalesce(jv.text(F.col("_d.type")) == "assistant", F.lit(False)) & usage.isNotNull()).alias("_request"),
        (F.floor(jv.moment_us(jv.text(F.col("_d.timestamp"))) / 1000) * 1000).alias("us"),
        text("message.id").alias("message_id"), text("requestId").alias("request_id"), text("sessionId").alias("session_id"), text("message.model").alias("model"),
        jv.count(usage["input_tokens"]).alias("input_tokens"), jv.count(usage["output_tokens"]).alias("output_tokens"), jv.count(usage["output_tokens_details"]["thinking_tokens"]).alias("thinking_tokens"),
        jv.count(usage["cache_read_input_tokens"]).alias("cache_read_tokens"),
        F.when(split, jv.count(usage["cache_creation"]["ephemeral_5m_input_tokens"])).otherwise(total).alias("cache_write_5m_tokens"),
        F.when(split, jv.count(usage["cache_creation"]["ephemeral_1h_input_tokens"])).otherwise(0).alias("cache_write_1h_tokens"),
        project_of(F.col("path")).alias("project"), jv.text(F.col("_d.gitBranch")).alias("git_branch"), jv.text(F.col("_d.entrypoint")).alias("entrypoint"), jv.text(usage["service_tier"]).alias("service_tier"),
        F.coalesce(jv.boolean(F.col("_d.isSidechain")), F.lit(False)).alias("is_sidechain"),
        (jv.text(F.col("_d.message.stop_reason")).isNotNull() | usage["iterations"].isNotNull()).alias("output_final"),
        total.alias("_total"), split.alias("_split"),
    ))
    read = read.withColumn("_good", F.col("_request") & F.col("us").isNotNull())
    good = F.col("_good")
    warn = lambda when, kind: F.when(when, F.lit(kind))
    warnings = F.array_compact(F.array(
        warn(F.col("_request") & F.col("us").isNull(), "bad-timestamp"),
        warn(good & F.col("_split") & (F.col("_total") > 0) & (F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens") != F.col("_total")), "cache-sum-mismatch"),
        warn(good & ~F.col("_split") & (F.col("_total") > 0), "missing-cache-breakdown"),
        warn(good & (F.col("request_id") == ""), "missing-request-id"),
    ))
    return read.withColumns({"semantic_id": semantic_id(), "warnings": warnings}).select("path", "pos", *EVENT_COLUMNS, "_good", "warnings")


def parse_requests(lines: DataFrame) -> DataFrame:
    """lines with (event, warnings): event is null where a line is no request, warnings say why or what is odd.

    A request is a JSON object of type assistant with a usage object. Cache writes are split into five-minute and
    one-hour tokens; without the split all are five-minute ones, with a warning.
    """
    return _parsed(lines).select("path", "pos", F.when(F.col("_good"), F.struct(*EVENT_COLUMNS)).alias("event"), "warnings")


def requests(lines: DataFrame) -> DataFrame:
    """The request events of a lines frame."""
    return _parsed(lines).where("_good").drop("_good", "warnings")


def parse_statistics(lines: DataFrame) -> DataFrame:
    """(kind, key, n): lines, events, warnings by kind, models, entry points, and message ids that several projects hold."""
    read = _parsed(lines).select("_good", "warnings", "model", "entrypoint", "message_id", "project")
    one = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    of_event = F.array(one("model", F.col("model")), one("entrypoint", F.coalesce("entrypoint", F.lit("(none)"))))
    facts = F.concat(F.array(one("lines", F.when(F.col("_good"), "event").otherwise("other"))), F.transform("warnings", lambda w: one("warning", w)), F.when(F.col("_good"), of_event).otherwise(F.array().cast("array<struct<kind:string,key:string>>")))
    counted = read.select(F.explode(facts).alias("f")).groupBy("f.kind", "f.key").agg(F.count("*").alias("n"))
    shared = read.where("_good").groupBy("message_id").agg(F.min("project").alias("a"), F.max("project").alias("z")).where("a <> z")
    return counted.unionByName(shared.groupBy(F.lit("duplicate").alias("kind"), F.lit("projects").alias("key")).agg(F.count("*").alias("n")))


def clean_title(title: Column) -> Column:
    """White space as single spaces, trimmed, at most TITLE_CHARS code points; null if nothing is left."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(title, "(?U)\\s+", " ")), 1, TITLE_CHARS), F.lit(""))


def session_titles(lines: DataFrame) -> DataFrame:
    """(session_id, title, kind): the last title line of each session; a user's own title is not displaced by an agent's."""
    likely = lines.where(F.col("value").contains('"custom-title"') | F.col("value").contains('"agent-name"'))  # before any JSON is parsed
    kind = jv.text(F.col("_d.type"))
    titles = likely.select("path", "pos", jv.read(F.col("value"), "type variant, sessionId variant, customTitle variant, agentName variant").alias("_d")).select(
        jv.text(F.col("_d.sessionId")).alias("session_id"),
        F.when(kind == "custom-title", clean_title(jv.text(F.col("_d.customTitle")))).when(kind == "agent-name", clean_title(jv.text(F.col("_d.agentName")))).alias("title"),
        F.when(kind == "custom-title", "custom").otherwise("agent").alias("kind"),
        F.struct("path", "pos").alias("_at"),
    )
    own = titles.where("session_id <> '' AND title IS NOT NULL")
    best = own.groupBy("session_id").agg(F.max_by(F.struct("title", "kind"), F.struct(F.col("kind") == "custom", F.col("_at"))).alias("b"))
    return best.select("session_id", "b.title", "b.kind")


def upsert_titles(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """stored(session_id, title, updated_us) with incoming ones; a title that does not change keeps its old time."""
    new = incoming.groupBy("session_id").agg(F.max_by(F.struct("title", "updated_us"), "updated_us").alias("n"))
    both = stored.withColumn("_s", F.lit(True)).join(new, "session_id", "full")
    changed = F.col("n").isNotNull() & (F.col("_s").isNull() | ~F.col("title").eqNullSafe(F.col("n.title")))
    return both.select("session_id", F.when(changed, F.col("n.title")).otherwise(F.col("title")).alias("title"), F.when(changed, F.col("n.updated_us")).otherwise(F.col("updated_us")).alias("updated_us"))


def owner_ids(lines: DataFrame) -> DataFrame:
    """(path, org_id, account_id): the last owners that a file's raw lines name, by pattern and without parsing them."""
    owner = lambda kind: F.nullif(F.regexp_extract("value", f'"owner{kind}Uuid"\\s*:\\s*"([0-9a-fA-F-]{{8,64}})"', 1), F.lit(""))
    found = lines.where(F.col("value").contains("Uuid")).select("path", "pos", owner("Organization").alias("org_id"), owner("Account").alias("account_id"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    return found.groupBy("path").agg(last("org_id"), last("account_id")).where("org_id IS NOT NULL OR account_id IS NOT NULL")


def number_lines(lines: DataFrame) -> DataFrame:
    """lines with their ordinal in the file, from 1, blank lines included."""
    return lines.withColumn("ordinal", F.row_number().over(Window.partitionBy("path").orderBy("pos")))
