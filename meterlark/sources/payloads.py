"""Official payloads as tables: quota responses, product breakdowns, organisations, ledger quota and account usage.

Each reader takes a frame with a JSON text column `raw` and keeps its other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.functions import json_values as jv

#: Spellings under which a reset time occurs, first match first (fixed values of the payloads).
RESET_KEYS = ("resets_at", "reset_at", "resetsAt", "resetAt")
_ENTRY = "kind variant, percent double, scope struct<model:struct<display_name:variant>>, utilization_pct variant, utilizationPct variant, utilization double, " + ", ".join(f"{k} variant" for k in RESET_KEYS)


def _epoch_us(value: Column) -> Column:
    """Seconds, or milliseconds where the number is that large, as microseconds."""
    return F.when(value > 1e11, value * 1000).otherwise(value * 1_000_000).cast("long")


def reset_us(entry: Column) -> Column:
    """When a window resets, by the first spelling that holds an ISO time or an epoch number."""
    told = F.transform(F.array(*[entry[key] for key in RESET_KEYS]), lambda v: F.coalesce(jv.moment_us(jv.text(v)), _epoch_us(jv.number(v))))
    return F.get(F.array_compact(told), F.lit(0))


def flat_pct(entry: Column) -> Column:
    """The percentage of a flat entry; it is never scaled, so 1 is one percent."""
    first = F.coalesce(F.when(~F.is_variant_null(entry["utilization_pct"]), entry["utilization_pct"]), entry["utilizationPct"])
    return F.coalesce(jv.number(first), entry["utilization"])


def limit_kind(entry: Column) -> Column:
    """The window kind of an entry of `limits`; a kind never seen before passes as it is."""
    kind, name = jv.text(entry["kind"]), F.trim(jv.text(entry["scope"]["model"]["display_name"]))
    scoped = F.when(name != "", F.concat(F.lit("seven_day_"), F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"))).otherwise("seven_day_scoped")
    return F.nullif(F.when(kind == "session", "five_hour").when(kind == "weekly_all", "seven_day").when(kind == "weekly_scoped", scoped).otherwise(kind), F.lit(""))


def quota_windows(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """One row for each window of a response: window_kind, pct, resets_us. Where `limits` has a usable entry only that counts."""
    keep = [c for c in responses.columns if c != raw]
    docs = jv.once(responses.select(*keep, jv.entries(F.col(raw)).alias("_m"))).where("_m IS NOT NULL").withColumn("_limits", jv.items(F.try_element_at("_m", F.lit("limits"))))
    usable = F.exists(F.transform("_limits", lambda e: jv.read(F.to_json(e), "kind variant, percent double")), lambda x: x["percent"].isNotNull() & jv.full_text(x["kind"]).isNotNull())
    listed = F.transform("_limits", lambda e: F.struct(F.lit(None).cast("string").alias("key"), e.alias("value")))
    flat = F.transform(F.map_entries("_m"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    each = docs.select(*keep, F.explode(F.when(F.coalesce(usable, F.lit(False)), listed).otherwise(flat)).alias("_x")).where(jv.is_object(F.col("_x.value")))
    read = jv.once(each.select(*keep, F.col("_x.key").alias("_key"), jv.read(F.to_json("_x.value"), _ENTRY).alias("_e")))
    e = F.col("_e")
    found = jv.once(read.select(*keep, F.coalesce("_key", limit_kind(e)).alias("window_kind"), F.when(F.col("_key").isNull(), e["percent"]).otherwise(flat_pct(e)).alias("pct"), reset_us(e).alias("resets_us")))
    return found.where("window_kind IS NOT NULL AND pct IS NOT NULL")


def product_breakdown(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """One row for each product of a breakdown, a whole response or the breakdown alone: as_of_us, window_started_us, key, label, share_pct."""
    keep = [c for c in responses.columns if c != raw]
    inner = F.try_element_at("_m", F.lit("seven_day_breakdown"))
    docs = responses.select(*keep, F.col(raw).alias("_raw"), jv.entries(F.col(raw)).alias("_m")).where("_m IS NOT NULL")
    alone = docs.select(*keep, jv.read(F.when(F.map_contains_key("_m", "seven_day_breakdown"), F.to_json(inner)).otherwise(F.col("_raw")), "as_of variant, window_started_at variant, rows variant").alias("_d"))
    rows = alone.select(*keep, "_d", F.explode(jv.items(F.col("_d.rows"))).alias("_r")).where(jv.is_object(F.col("_r")))
    read = rows.select(*keep, "_d", jv.read(F.to_json("_r"), "key variant, display_name variant, percent double").alias("_e"))
    return read.select(
        *keep,
        jv.moment_us(jv.text(F.col("_d.as_of"))).alias("as_of_us"),
        jv.moment_us(jv.text(F.col("_d.window_started_at"))).alias("window_started_us"),
        jv.full_text(F.col("_e.key")).alias("key"),
        F.coalesce(jv.full_text(F.col("_e.display_name")), jv.text(F.col("_e.key"))).alias("label"),
        F.col("_e.percent").alias("share_pct"),
    ).where("key IS NOT NULL AND share_pct IS NOT NULL")


def plan_of(tier: Column) -> Column:
    """The plan that a rate-limit tier stands for."""
    plain = F.regexp_replace(tier, "^default_", "")
    return F.when(F.nullif(tier, F.lit("")).isNull(), F.lit(None)).when((plain == "raven") | plain.startswith("raven_"), "team").otherwise(F.regexp_replace(plain, "^claude_", ""))


def organisations(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """One row for each organisation of a list: org_id, name, plan, capabilities, and whether it is the only possible one.

    A list is judged in its own row: nothing would tell it from others with the same columns.
    """
    keep = [c for c in responses.columns if c != raw]
    org = "uuid variant, id variant, name variant, rate_limit_tier variant, capabilities variant"
    lists = jv.once(responses.select(*keep, F.from_json(raw, "array<variant>").alias("_all")))
    read = jv.once(lists.select(*keep, F.transform(F.filter("_all", jv.is_object), lambda o: jv.read(F.to_json(o), org)).alias("_read")))

    def named(e: Column) -> Column:
        first = F.coalesce(F.when(~F.is_variant_null(e["uuid"]), e["uuid"]), e["id"])
        caps = F.transform(F.filter(jv.items(e["capabilities"]), lambda c: F.schema_of_variant(c) == "STRING"), lambda c: c.cast("string"))
        return F.struct(jv.full_text(first).alias("org_id"), F.coalesce(jv.text(e["name"]), F.lit("")).alias("name"), plan_of(jv.text(e["rate_limit_tier"])).alias("plan"), F.coalesce(caps, F.array().cast("array<string>")).alias("capabilities"))

    orgs = jv.once(read.select(*keep, F.transform("_read", named).alias("_named")))
    orgs = jv.once(orgs.select(*keep, F.filter("_named", lambda o: o["org_id"].isNotNull()).alias("_orgs")))
    usable = lambda o: F.arrays_overlap(o["capabilities"], F.array(F.lit("raven"), F.lit("claude_max"), F.lit("claude_pro")))
    o = F.col("_o")
    each = orgs.select(*keep, F.size("_orgs").alias("_n"), F.size(F.filter("_orgs", usable)).alias("_u"), F.explode("_orgs").alias("_o"))
    return each.select(*keep, *[o[c].alias(c) for c in ("org_id", "name", "plan", "capabilities")], ((F.col("_n") == 1) | ((F.col("_u") == 1) & usable(o))).alias("unambiguous"))


# --- the second ledger ---------------------------------------------------------------------------------


def component(text: Column) -> Column:
    """Percent-encoding of one URI component."""
    out = F.url_encode(text)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def _limit(limit_id: Column, label: Column, slots: dict[str, Column]) -> Column:
    """A limit with its windows, a struct(pct, minutes, resets_us) or null for each slot."""
    each = [F.when(w.isNotNull(), F.struct(F.lit(slot).alias("slot"), w["pct"].alias("pct"), w["minutes"].cast("long").alias("minutes"), w["resets_us"].alias("resets_us"))) for slot, w in slots.items()]
    return F.struct(limit_id.alias("limit_id"), label.alias("label"), F.array_compact(F.array(*each)).alias("windows"))


def _windows(limits: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each window of the array _limits; a snapshot with a percentage that is missing or outside 0..100 is refused whole.

    A snapshot is judged in its own row: nothing would tell it from others with the same columns.
    """
    fits = F.forall("_limits", lambda x: F.forall(x["windows"], lambda w: F.coalesce(w["pct"].between(0, 100), F.lit(False))))
    each = jv.once(limits).where(fits).select(*keep, F.explode("_limits").alias("_x")).select(*keep, F.col("_x.limit_id").alias("limit_id"), F.col("_x.label").alias("label"), F.explode("_x.windows").alias("_w"))
    w = F.col("_w")
    return each.select(*keep, F.concat(component(F.col("limit_id")), F.lit(":"), w["slot"]).alias("window_id"), "limit_id", "label", *[w[c].alias(c) for c in ("slot", "pct", "minutes", "resets_us")])


def _epoch_seconds_us(value: Column) -> Column:
    return (value * 1_000_000).cast("long")


def ledger_windows_web(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Windows of a web usage response: window_id, limit_id, label, slot, pct, minutes (seconds rounded up), resets_us.

    A window object without a percentage refuses its snapshot.
    """
    keep = [c for c in responses.columns if c != raw]
    window = "struct<used_percent:double,limit_window_seconds:double,reset_at:double>"
    rate = f"struct<primary_window:{window},secondary_window:{window}>"

    def slots(rate_limit: Column) -> dict[str, Column]:
        found = {}
        for slot in ("primary", "secondary"):
            w = rate_limit[f"{slot}_window"]
            seconds, resets = w["limit_window_seconds"], w["reset_at"]
            found[slot] = F.when(w.isNotNull(), F.struct(w["used_percent"].alias("pct"), F.when(seconds > 0, F.ceil(seconds / 60)).alias("minutes"), F.when(resets > 0, _epoch_seconds_us(resets)).alias("resets_us")))
        return found

    docs = jv.once(responses.select(*keep, jv.read(F.col(raw), f"rate_limit {rate}, additional_rate_limits variant").alias("_d")))
    more = F.transform(F.slice(jv.items(F.col("_d.additional_rate_limits")), 1, 50), lambda x: jv.read(F.to_json(x), f"metered_feature variant, limit_name variant, rate_limit {rate}"))
    read = jv.once(docs.select(*keep, F.col("_d.rate_limit").alias("_own"), more.alias("_more")))
    own = _limit(F.lit("codex"), F.lit(None).cast("string"), slots(F.col("_own")))
    extra = F.filter(F.transform("_more", lambda e: _limit(jv.full_text(e["metered_feature"]), jv.full_text(e["limit_name"]), slots(e["rate_limit"]))), lambda x: x["limit_id"].isNotNull())
    named = jv.once(read.select(*keep, own.alias("_own"), extra.alias("_extra")))
    none = F.filter(F.array("_own"), lambda x: F.lit(False))
    return _windows(named.select(*keep, F.concat(F.array("_own"), F.coalesce("_extra", none)).alias("_limits")), keep)


def ledger_windows_client(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """The same windows from a client's answer: limits by id, or the one older limit if there is no such map."""
    keep = [c for c in responses.columns if c != raw]
    docs = jv.once(responses.select(*keep, jv.read(F.col(raw), "rateLimitsByLimitId variant, rateLimits variant").alias("_d")))
    by_id, older = F.col("_d.rateLimitsByLimitId"), F.col("_d.rateLimits")
    listed = F.transform(F.map_entries(F.try_variant_get(by_id, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    one = F.when(jv.is_object(older), F.array(F.struct(F.lit(None).cast("string").alias("key"), older.alias("value"))))
    given = jv.once(docs.select(*keep, F.when(jv.is_object(by_id), listed).otherwise(one).alias("_given")))
    window = "struct<usedPercent:double,windowDurationMins:double,resetsAt:double>"
    parsed = F.transform("_given", lambda x: F.struct(x["key"].alias("key"), jv.read(F.to_json(x["value"]), f"limitId variant, limitName variant, primary {window}, secondary {window}").alias("e")))
    read = jv.once(given.select(*keep, parsed.alias("_read")))

    def limit(x: Column) -> Column:
        slots = {}
        for slot in ("primary", "secondary"):
            w = x["e"][slot]
            slots[slot] = F.when(w.isNotNull(), F.struct(w["usedPercent"].alias("pct"), F.when(w["windowDurationMins"] > 0, w["windowDurationMins"]).cast("long").alias("minutes"), _epoch_seconds_us(w["resetsAt"]).alias("resets_us")))
        return _limit(F.coalesce(x["key"], jv.full_text(x["e"]["limitId"]), F.lit("codex")), jv.full_text(x["e"]["limitName"]), slots)

    return _windows(read.select(*keep, F.transform("_read", limit).alias("_limits")), keep)


def account_usage(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Official totals: lifetime_tokens and one row for each day; a response with a bad day is refused whole.

    They are cumulative and never added to local events.
    """
    keep = [c for c in responses.columns if c != raw]
    docs = responses.select(*keep, jv.read(F.col(raw), "summary struct<lifetimeTokens:double>, dailyUsageBuckets array<struct<startDate:variant,tokens:double>>").alias("_d")).where("_d.summary IS NOT NULL")
    whole = lambda v: F.coalesce((v >= 0) & (v == F.floor(v)), F.lit(False))
    days = F.transform("_d.dailyUsageBuckets", lambda d: F.struct(jv.text(d["startDate"]).alias("day"), d["tokens"].alias("tokens")))
    life = F.col("_d.summary.lifetimeTokens")
    fit = docs.select(*keep, F.when(whole(life), life.cast("long")).alias("lifetime_tokens"), days.alias("_days"))
    good = fit.where(F.coalesce(F.forall("_days", lambda d: F.coalesce(d["day"].rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) & whole(d["tokens"])), F.lit(True)))
    return good.select(*keep, "lifetime_tokens", F.explode_outer("_days").alias("_x")).select(*keep, "lifetime_tokens", F.col("_x.day").alias("day"), F.col("_x.tokens").cast("long").alias("tokens"))
