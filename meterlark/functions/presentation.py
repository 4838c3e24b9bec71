"""Presentation scalars: names, labels, formats and states as Column expressions.

Labels are English; numbers, thresholds and rounding (half up) are those of the reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.functions.scalars import half_up

#: Model families with a display name, and windows that always have a place (fixed values of the domain).
FAMILIES = ("opus", "sonnet", "haiku", "fable", "mythos")
CORE_KINDS = ("five_hour", "seven_day", "seven_day_fable", "seven_day_opus")
DAY_MINUTES = 1440


def counts_toward_quota_exact(model: str = "model") -> Column:
    """The stored form of the quota predicate: case and blanks as they are."""
    return (F.col(model) != "<synthetic>") & F.col(model).rlike(r"^(claude|(opus|sonnet|haiku|fable)([-.]|$))")


def ratio_to_pct(ratio: Column) -> Column:
    return ratio * 100


def window_family(kind: Column) -> Column:
    """The model family that a scoped window is about; none for the unnamed scope."""
    family = F.lower(F.regexp_extract(kind, "^seven_day_(.+)$", 1))
    return F.nullif(F.nullif(family, F.lit("")), F.lit("scoped"))


def model_in_family(model: Column, family: Column) -> Column:
    name = F.regexp_replace(F.lower(F.trim(model)), r"^claude[-.]", "")
    return (name == family) | F.startswith(name, F.concat(family, F.lit("-"))) | F.startswith(name, F.concat(family, F.lit(".")))


def model_name(model: Column) -> Column:
    """A readable model name, or the model as it is where the pattern is not known."""
    m = F.lower(F.trim(model))
    for suffix in (r"^claude[-.]", r"\[[^\]]*\]$", r"@.*$", r"-\d{8}$"):
        m = F.regexp_replace(m, suffix, "")
    families = "|".join(FAMILIES)
    new, old = rf"^({families})-(\d+)(?:-(\d+))?$", rf"^(\d+)(?:-(\d+))?-({families})$"
    part = lambda pattern, i: F.regexp_extract(m, pattern, i)
    cap = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 100))
    dotted = lambda s: F.when(s != "", F.concat(F.lit("."), s)).otherwise("")
    return (
        F.when(m.rlike(new), F.concat(cap(part(new, 1)), F.lit(" "), part(new, 2), dotted(part(new, 3))))
        .when(m.rlike(old), F.concat(cap(part(old, 3)), F.lit(" "), part(old, 1), dotted(part(old, 2))))
        .otherwise(model)
    )


def is_scratch(project: Column) -> Column:
    return F.coalesce(F.contains(project, F.lit("-scratch-workspaces-")), F.lit(False))


def project_label(project: Column) -> Column:
    """Ten digits of a hashed name, the day of a scratch folder, else the last part of the path name."""
    scratch = r"(?i)-scratch-\d{4}-(\d{2})-(\d{2})-[0-9a-z]+$"
    day = F.concat(F.lit("scratch "), F.regexp_extract(project, scratch, 1), F.lit("-"), F.regexp_extract(project, scratch, 2))
    tail = F.try_element_at(F.filter(F.split(project, "-"), lambda x: x != ""), F.lit(-1))
    return F.when(project.rlike("(?i)^[0-9a-f]{16,}$"), F.substring(project, 1, 10)).when(project.rlike(scratch) & is_scratch(project), day).otherwise(F.coalesce(tail, project))


def session_label(title: Column, session: Column) -> Column:
    return F.coalesce(title, F.concat(F.lit("untitled · "), F.substring(session, 1, 8)))


def session_place(project: Column, machine: Column) -> Column:
    """Project and machine of a session, what is known of them."""
    where = F.when(F.nullif(project, F.lit("")).isNotNull(), F.when(is_scratch(project), "scratch").otherwise(project_label(project)))
    return F.concat_ws(" · ", where, F.nullif(machine, F.lit("")))


def machine_label(hostname: Column, machine: Column) -> Column:
    return F.coalesce(F.nullif(hostname, F.lit("")), machine)


def tokens_text(n: Column) -> Column:
    size = F.abs(n)
    # Half up on the double, as the reports do; a format rounds the shortest decimal, which makes 1.01 of 1.005.
    rounded = lambda x, digits: F.format_string(f"%.{digits}f", half_up(x * 10.0**digits) / 10.0**digits)
    return (
        F.when(n.isNull(), "—").when(size >= 1e9, F.concat(rounded(n / 1e9, 2), F.lit("B"))).when(size >= 1e6, F.concat(rounded(n / 1e6, 1), F.lit("M")))
        .when(size >= 1e3, F.concat(F.format_string("%.0f", n / 1e3), F.lit("K"))).otherwise(half_up(n).cast("string"))
    )


def pct_text(pct: Column, digits: int = 1) -> Column:
    return F.when(pct.isNull(), "—").otherwise(F.concat(F.format_string(f"%.{digits}f", pct), F.lit("%")))


def usd_text(usd: Column) -> Column:
    """Dollars with three digits below ten cents, else two."""
    return F.concat(F.lit("$"), F.when(usd < 0.1, F.format_string("%.3f", usd)).otherwise(F.format_string("%.2f", usd)))


def duration_text(ms: Column) -> Column:
    """1:48, or 3d 04h from a day on."""
    minutes = half_up(ms / 60_000)
    day = F.concat(F.floor(minutes / DAY_MINUTES), F.lit("d "), F.lpad(F.floor(minutes % DAY_MINUTES / 60).cast("string"), 2, "0"), F.lit("h"))
    clock = F.concat(F.floor(minutes / 60), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))
    return F.when(ms.isNull() | (ms <= 0), "0:00").when(minutes >= DAY_MINUTES, day).otherwise(clock)


def until_text(ms: Column) -> Column:
    minutes = half_up(ms / 60_000)
    d, h, m = F.floor(minutes / DAY_MINUTES), F.floor(minutes % DAY_MINUTES / 60), minutes % 60
    unit = lambda n, name: F.concat(n.cast("string"), F.lit(f" {name}"))
    days = F.when(h > 0, F.concat_ws(" ", unit(d, "d"), unit(h, "h"))).otherwise(unit(d, "d"))
    hours = F.when(m > 0, F.concat_ws(" ", unit(h, "h"), unit(m, "min"))).otherwise(unit(h, "h"))
    text = F.when(minutes < 60, unit(minutes, "min")).when(d >= 1, days).otherwise(hours)
    return F.when(ms.isNull(), "—").when(ms <= 60_000, "now").otherwise(F.concat(F.lit("in "), text))


def when_text(target_us: Column, now_us: Column, zone: str = "UTC") -> Column:
    """The local clock of a moment: alone today, after `tomorrow`, else with its date and weekday."""
    local = lambda us: F.from_utc_timestamp(F.timestamp_micros(us), zone)
    days = F.datediff(F.to_date(local(target_us)), F.to_date(local(now_us)))
    clock = F.date_format(local(target_us), "HH:mm")
    return F.when(target_us.isNull(), "—").when(days == 0, clock).when(days == 1, F.concat(F.lit("tomorrow "), clock)).otherwise(F.date_format(local(target_us), "MM-dd EEE HH:mm"))


def pace(minutes: Column, resets_us: Column, now_us: Column) -> Column:
    """The part of a window's time that is over, 0 to 1; null where length or reset are not known."""
    span = minutes.cast("long") * 60_000_000
    return F.when(resets_us.isNotNull() & minutes.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(now_us - (resets_us - span), span))))


def is_meaningful(pct: Column, resets_us: Column) -> Column:
    return resets_us.isNotNull() | (pct > 0)


def is_active(resets_us: Column) -> Column:
    return resets_us.isNotNull()


def kind_rank(kind: Column) -> Column:
    out = F.when(kind == CORE_KINDS[0], 0)
    for i, name in enumerate(CORE_KINDS[1:], 1):
        out = out.when(kind == name, i)
    return out.otherwise(len(CORE_KINDS))


def shown_windows(windows: DataFrame) -> DataFrame:
    """The windows a dashboard shows, core kinds always, with their position by profile."""
    from pyspark.sql import Window

    kept = windows.where((kind_rank(F.col("window_kind")) < len(CORE_KINDS)) | is_meaningful(F.col("pct"), F.col("resets_us")))
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("profile_id").orderBy(kind_rank(F.col("window_kind")), "window_kind")))


def is_stale(captured_us: Column, now_us: Column, stale_us: int = 900_000_000) -> Column:
    return now_us - captured_us > stale_us


def time_range(df: DataFrame, from_us: int | None, to_us: int | None, now_us: int, span_us: int = 7 * 86_400_000_000) -> DataFrame:
    """Rows with from <= us < to; the end is now and the span as given where they are left out."""
    to_us = now_us if to_us is None else to_us
    from_us = to_us - span_us if from_us is None else from_us
    if from_us >= to_us:
        raise ValueError("from must be before to")
    return df.where((F.col("us") >= from_us) & (F.col("us") < to_us))


def tray_text(pct: Column) -> Column:
    return F.when(pct.isNull(), "--%").otherwise(F.concat(half_up(pct).cast("string"), F.lit("%")))


def tight(windows: DataFrame) -> DataFrame:
    """By profile: whether a window will be exhausted or is projected to 100 or more."""
    return windows.groupBy("profile_id").agg(F.bool_or(F.col("eta_ms").isNotNull() | (F.col("mid_pct") >= 100)).alias("tight"))


def headline(windows: DataFrame, now_us: int) -> DataFrame:
    """By profile the one thing to say: tone, what (exhausts, hot, safe), the window kind it is about, and a figure.

    windows(profile_id, window_kind, pct, resets_us, mid_pct, eta_ms). First the earliest exhaustion (danger within
    45 minutes), else the highest projection of 90 or more, else the week, else the five hours.
    """
    active = F.col("resets_us").isNotNull()
    eta = F.when(active, F.col("eta_ms"))
    hot = active & (F.col("mid_pct") >= 90)
    of = lambda kind, value, condition=F.lit(True): F.max(F.when((F.col("window_kind") == kind) & condition, value))
    one = windows.groupBy("profile_id").agg(
        F.min(eta).alias("_eta"), F.min_by("window_kind", F.when(eta.isNotNull(), F.struct(eta, "window_kind"))).alias("_eta_kind"),
        F.max(F.when(hot, F.col("mid_pct"))).alias("_hot"), F.max_by("window_kind", F.when(hot, F.struct("mid_pct", "window_kind"))).alias("_hot_kind"),
        of("seven_day", F.col("pct"), active).alias("_week"), of("five_hour", F.lit(1)).alias("_five"), of("five_hour", F.col("pct"), active).alias("_five_pct"),
    )
    soon = F.col("_eta") - now_us / 1000 < 45 * 60_000
    pick = lambda a, b, c, d: F.when(F.col("_eta").isNotNull(), a).when(F.col("_hot").isNotNull(), b).when(F.col("_week").isNotNull(), c).when(F.col("_five").isNotNull(), d)
    return one.select(
        "profile_id",
        pick(F.when(soon, "danger").otherwise("warn"), F.lit("warn"), F.lit("ok"), F.lit("ok")).alias("tone"),
        pick(F.lit("exhausts"), F.lit("hot"), F.lit("safe"), F.when(F.col("_five_pct").isNull(), "idle").otherwise("safe")).alias("what"),
        pick(F.col("_eta_kind"), F.col("_hot_kind"), F.lit("seven_day"), F.lit("five_hour")).alias("window_kind"),
        pick(F.col("_eta").cast("double"), F.col("_hot"), F.col("_week"), F.col("_five_pct")).alias("figure"),
    ).where("tone IS NOT NULL")


def collector_tone(state: Column, stale: Column) -> Column:
    return F.when(state != "ok", "danger").when(stale, "warn").otherwise("ok")


def collector_label(state: Column, error: Column, stale: Column) -> Column:
    return (
        F.when(state == "auth", F.when(error.like("%server_blocked"), "blocked").otherwise("signed out"))
        .when(state == "error", F.when(error.like("%events_rejected"), "events rejected").otherwise("collection failed"))
        .when(stale, "stale").otherwise("normal")
    )


def cumulative_text(pct: Column, has_gap: Column) -> Column:
    return F.concat(F.when(has_gap, "≥").otherwise(""), half_up(pct).cast("string"), F.lit("%"))


def share_points(weekly_pct: Column, share_pct: Column) -> Column:
    """A product's share as points of the weekly limit."""
    return weekly_pct * share_pct / 100


def hour_ticks(spark, from_ms: int, to_ms: int, unit: str = "hour") -> DataFrame:
    """The UTC hours or days that [from, to) touches, at most 2000."""
    step = 3_600_000 if unit == "hour" else 86_400_000
    if to_ms <= from_ms:
        return spark.range(0).withColumnRenamed("id", "tick_ms")
    return spark.range(from_ms // step * step, to_ms, step).withColumnRenamed("id", "tick_ms").limit(2000)


def day_ticks(spark, from_us: int, to_us: int, zone: str) -> DataFrame:
    """The local midnights of a zone that [from, to) touches, at most 400; days of 23 and 25 hours count as one."""
    local = lambda us: F.from_utc_timestamp(F.timestamp_micros(F.lit(us)), zone)
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(local(from_us)), F.to_date(local(to_us)))).alias("day"))
    ticks = days.withColumn("tick_us", F.unix_micros(F.to_utc_timestamp(F.col("day").cast("timestamp"), zone)))
    return ticks.where(F.col("tick_us") < to_us).orderBy("tick_us").limit(400)


def is_work_mode(model: Column) -> Column:
    return model.endswith("-wm")


def base_model(model: Column) -> Column:
    return F.regexp_replace(model, "-wm$", "")


def has_open_flags(flags: Column, neutral: tuple[str, ...]) -> Column:
    """Whether an event has a quality flag that is not a neutral one."""
    return F.exists(F.array_distinct(flags), lambda f: ~f.isin(*neutral))


def canonical_hash(df: DataFrame) -> Column:
    """Digest of a row as JSON with keys in order and nulls written out."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


