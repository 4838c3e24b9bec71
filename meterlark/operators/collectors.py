"""Collectors and the stores they feed: conflicts, warnings, queues, labels, upserts, repricing, local days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlark.functions.scalars import counts_toward_quota, quota_tokens

#: Flags that say nothing against an event's completeness (fixed value).
NEUTRAL_FLAGS = ("configured_account_history",)


def with_conflicts(events: DataFrame, conflicts: DataFrame, keys: Sequence[str] = ("account_id", "event_id")) -> DataFrame:
    """events with the number of conflicting copies of each, 0 where there is none."""
    counts = conflicts.groupBy(*keys).agg(F.count("*").alias("conflicts"))
    return events.join(counts, list(keys), "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))


def collector_states(collectors: DataFrame, conflicts: DataFrame, warnings: DataFrame, machines: DataFrame, now_us: int, stale_us: int = 900_000_000) -> DataFrame:
    """One row for each collector(machine_id, captured_us, state, error): conflicts, warnings by scope, host name, staleness.

    warnings(machine_id, scope, n): `withheld` ones may hide usage, all others are notes.
    """
    by_machine = conflicts.groupBy("machine_id").agg(F.count("*").alias("conflicts"))
    split = warnings.groupBy("machine_id").agg(F.sum(F.when(F.col("scope") == "withheld", F.col("n"))).alias("withheld"), F.sum(F.when(F.col("scope") != "withheld", F.col("n"))).alias("notes"))
    joined = collectors.join(by_machine, "machine_id", "left").join(split, "machine_id", "left").join(F.broadcast(machines.select("machine_id", "hostname")), "machine_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("machine_id", F.coalesce(F.nullif("hostname", F.lit("")), "machine_id").alias("label"), "captured_us", "state", "error", zero("conflicts"), zero("withheld"), zero("notes"), (F.lit(now_us) - F.col("captured_us") > stale_us).alias("stale"))


def upsert_collectors(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(machine_id, captured_us, backfill_from_us, state): the newer report's state, the latest time, the earliest start."""
    both = stored.unionByName(incoming)
    return both.groupBy("machine_id").agg(F.max("captured_us").alias("captured_us"), F.min("backfill_from_us").alias("backfill_from_us"), F.max_by("state", "captured_us").alias("state"))


def outbox(events: DataFrame, rejected: DataFrame, keys: Sequence[str] = ("event_id",)) -> DataFrame:
    """Events that no rejection holds back."""
    return events.join(rejected.select(*keys).distinct(), list(keys), "left_anti")


def trimmed_queue(queue: DataFrame, most: int, keys: Sequence[str] = (), order: str = "seq") -> DataFrame:
    """The newest `most` rows of each queue; the oldest go first."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return queue.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def history_by_moment(history: DataFrame, keys: Sequence[str] = ("account_id", "window_id", "captured_us")) -> DataFrame:
    """One row for each moment, from the smallest machine id."""
    rest = [c for c in history.columns if c not in keys]
    return history.groupBy(*keys).agg(F.min_by(F.struct(*rest), "machine_id").alias("_r")).select(*keys, "_r.*")


def latest_snapshot(snapshots: DataFrame, server: str | None = None, fresh_after_us: int | None = None, key: str = "account_id") -> DataFrame:
    """The newest snapshot of each account (smaller machine id on a tie); one of the server's own, if it is fresh, first."""
    preferred = F.lit(0)
    if server is not None and fresh_after_us is not None:
        preferred = F.when((F.col("machine_id") == server) & (F.col("captured_us") >= fresh_after_us), 1).otherwise(0)
    w = Window.partitionBy(key).orderBy(preferred.desc(), F.col("captured_us").desc(), "machine_id")
    return snapshots.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def earliest_expiry(credits: Column) -> Column:
    """When the first available credit of array<struct<status,expires_us>> expires."""
    return F.array_min(F.transform(F.filter(credits, lambda c: (c["status"] == "available") & c["expires_us"].isNotNull()), lambda c: c["expires_us"]))


def by_duration(windows: DataFrame, key: str = "account_id") -> DataFrame:
    """Windows with their position by length, unknown lengths last."""
    return windows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(F.col("minutes").asc_nulls_last(), "window_id")))


def primary_window(states: DataFrame, key: str = "profile_id") -> DataFrame:
    """The one row a widget shows: what runs out first, else what is fullest."""
    order = F.struct(F.when(F.col("eta_ms").isNotNull(), 0).otherwise(1), F.col("eta_ms"), -F.col("pct"), F.col("window_kind"))
    return states.groupBy(key).agg(F.min_by(F.struct("window_kind", "pct", "eta_ms"), order).alias("_p")).select(key, "_p.*")


def by_cost(buckets: DataFrame) -> DataFrame:
    """Buckets(key, total_tokens, cost_usd) with their position: priced ones by cost, then the others by tokens."""
    tokens = F.when(F.col("cost_usd").isNull(), F.col("total_tokens"))
    return buckets.withColumn("position", F.row_number().over(Window.orderBy(F.col("cost_usd").desc_nulls_last(), tokens.desc_nulls_last(), "key")))


def labelled(buckets: DataFrame, labels: DataFrame, key: str = "key") -> DataFrame:
    """buckets with the label of their key from labels(key, label), the key itself where there is none."""
    return buckets.join(F.broadcast(labels.select(F.col("key").alias(key), "label")), key, "left").withColumn("label", F.coalesce(F.nullif("label", F.lit("")), F.col(key)))


def update_values(stored: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """stored with the columns of values where a key matches; a null there is a value too."""
    columns = [c for c in values.columns if c not in keys]
    fresh = values.select(*keys, F.struct(*columns).alias("_new"))
    joined = stored.join(fresh, list(keys), "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])


def stale_prices(events: DataFrame, version: str) -> DataFrame:
    """Events whose stored cost was made with another catalog, or none."""
    return events.where(~F.col("price_version").eqNullSafe(F.lit(version)))


def coverage_totals(events: DataFrame, by: Sequence[Column], withheld: DataFrame | None = None) -> DataFrame:
    """Totals of the second ledger by key and in all (key null): priced share, reasons and flags as text histograms, completeness.

    events(input_tokens, output_tokens, cost_usd, missing_reason, price_version, flags). Withheld records of any
    collector, withheld(n), make the grand total incomplete: nobody knows which key they belong to.
    """
    tokens = F.col("input_tokens") + F.col("output_tokens")
    keyed = events.select(F.explode(F.array(*[F.struct(F.lit(False).alias("total"), k.cast("string").alias("key")) for k in by], F.struct(F.lit(True).alias("total"), F.lit(None).cast("string").alias("key")))).alias("_g"), "*")
    open_flags = F.exists("flags", lambda f: ~f.isin(*NEUTRAL_FLAGS))
    sums = keyed.groupBy("_g").agg(
        F.count("*").alias("events"), F.sum(tokens).alias("tokens"), F.sum("cost_usd").alias("_usd"), F.count("cost_usd").alias("priced"), F.round(F.try_divide(F.sum(F.when(F.col("cost_usd").isNotNull(), tokens)) * 100.0, F.sum(tokens)), 4).alias("coverage_pct"),
        F.array_join(F.array_sort(F.collect_set("price_version")), ",").alias("price_versions"), F.count_if(open_flags).alias("flagged"),
    )
    text = lambda name: F.array_join(F.array_sort(F.collect_list(F.concat("_k", F.lit("="), "_n"))), ",").alias(name)
    histogram = lambda rows, name: rows.groupBy("_g", "_k").agg(F.count("*").alias("_n")).groupBy("_g").agg(text(name))
    reasons = histogram(keyed.where("missing_reason IS NOT NULL").withColumn("_k", F.col("missing_reason")), "reasons")
    flags = histogram(keyed.withColumn("_k", F.explode(F.array_distinct("flags"))), "flags")
    joined = sums.join(reasons, "_g", "left").join(flags, "_g", "left")
    hidden = F.lit(False)
    if withheld is not None:
        joined = joined.crossJoin(F.broadcast(withheld.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_withheld"))))  # one row
        hidden = F.col("_g.total") & (F.col("_withheld") > 0)
    return joined.select(
        "_g.key", "_g.total", "events", "tokens", F.round("_usd", 12).cast("double").alias("cost_usd"), "priced", "coverage_pct", "price_versions", F.coalesce("reasons", F.lit("")).alias("reasons"), F.coalesce("flags", F.lit("")).alias("flags"),
        ((F.col("flagged") == 0) & ~hidden).alias("usage_complete"), ((F.col("flagged") == 0) & (F.col("priced") == F.col("events")) & ~hidden).alias("cost_complete"),
    )


# --- local days -----------------------------------------------------------------------------------------


def local_day(us: Column, zone: str) -> tuple[Column, Column, Column]:
    """Start and end of the local day of a moment in microseconds, and its weekday (Sunday 0); days of 23 and 25 hours included."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_micros(us), zone))
    start = lambda d: F.unix_micros(F.to_utc_timestamp(d.cast("timestamp"), zone))
    return start(day), start(F.date_add(day, 1)), (F.dayofweek(day) - 1).cast("int")


def local_heat_grid(usage: DataFrame, zone: str) -> DataFrame:
    """Tokens by local weekday (Monday 0) and hour, all 7 x 24 cells."""
    local = F.from_utc_timestamp(F.timestamp_micros("us"), zone)
    cells = usage.sparkSession.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    sums = usage.where(counts_toward_quota()).groupBy(F.weekday(local).alias("weekday"), F.hour(local).alias("hour")).agg(F.sum(quota_tokens()).alias("total_tokens"))
    return cells.join(F.broadcast(sums), ["weekday", "hour"], "left").withColumn("total_tokens", F.coalesce("total_tokens", F.lit(0)))


def local_weekday_weights(events: DataFrame, zone: str, key: str = "profile_id", least_days: int = 7) -> DataFrame:
    """calendar.weekday_weights over the local days of a zone: (key, weekday Sunday 0, weight)."""
    from meterlark.operators.calendar import weekday_weights

    local = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros("us"), zone))
    # A local wall time taken as UTC falls into the day of that name, whatever its length.
    return weekday_weights(events.select(key, local.alias("us"), "tokens"), key, least_days)
