"""Aggregations over usage: distributions, totals, hourly rollups, shares, top-N, grids, fork merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlark.functions.scalars import TOKEN_PARTS, counts_toward_quota, quota_tokens


def dimension(by: str) -> Column:
    """The grouping key of a distribution; missing projects and sessions are `(unknown)`."""
    return {
        "model": F.col("model"),
        "machine": F.col("machine_id"),
        "project": F.coalesce(F.col("project"), F.lit("(unknown)")),
        "session": F.coalesce(F.nullif(F.col("session_id"), F.lit("")), F.lit("(unknown)")),
        "attribution": F.col("attribution_level"),
        "hour": F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"),
    }[by]


def _measures() -> list[Column]:
    sums = [F.sum(p).alias(p) for p in TOKEN_PARTS]
    return [
        F.count("*").alias("events"),
        *sums,
        F.sum(quota_tokens()).alias("total_tokens"),
        F.round(F.sum("cost_usd"), 6).cast("double").alias("cost_usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced_events"),
        F.count_if(F.col("output_final") == F.lit(False)).alias("partial_output"),
    ]


def distribution(usage: DataFrame, by: str) -> DataFrame:
    """Usage by one dimension, requests that do not count toward the quota left out; cost is null if nothing has a price."""
    return usage.where(counts_toward_quota()).groupBy(dimension(by).alias("key")).agg(*_measures())


def distribution_series(usage: DataFrame, by: str, unit: str) -> DataFrame:
    """Usage by dimension and UTC hour or day, one row for each."""
    bucket = F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz")
    return usage.where(counts_toward_quota()).groupBy(dimension(by).alias("key"), bucket.alias("bucket")).agg(
        F.count("*").alias("events"), F.sum(quota_tokens()).alias("total_tokens"), F.round(F.sum("cost_usd"), 6).cast("double").alias("cost_usd"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced_events")
    )


def usage_hourly(usage: DataFrame) -> DataFrame:
    """Rollup by profile, machine, model and UTC hour, with distinct sessions and what counts toward the quota."""
    counted = F.col("model") != "<synthetic>"
    return usage.groupBy("profile_id", "machine_id", "model", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")).agg(
        F.count("*").alias("events"),
        F.countDistinct("session_id").alias("sessions"),
        F.sum(quota_tokens()).alias("total_tokens"),
        F.sum(F.when(counted, quota_tokens())).alias("quota_tokens"),
        F.count_if(counted).alias("quota_events"),
    )


#: What is added up in the hourly rollup, for each session; cost in millionths, as the store rounds it.
COUNTED = ("events", *TOKEN_PARTS, "thinking_tokens", "cost_micro", "priced", "unpriced_events")


def hourly_rows(usage: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Each request of usage(…, cost_usd) as what it adds to its session's hour: keep, group and COUNTED columns."""
    micro = F.round(F.col("cost_usd") * 1_000_000, 0).cast("long")
    one = lambda c: F.when(c, F.lit(1)).otherwise(0).cast("long")
    counts = {"events": F.lit(1).cast("long"), "cost_micro": F.coalesce(micro, F.lit(0)).cast("long"), "priced": one(F.col("cost_usd").isNotNull()), "unpriced_events": one(F.col("cost_usd").isNull())}
    hour = (F.floor(F.col("us") / 3_600_000_000) * 3_600_000_000).cast("long")
    return usage.select(*keep, "profile_id", "machine_id", "model", hour.alias("hour_us"), F.coalesce("session_id", F.lit("")).alias("session_id"), *[counts.get(c, F.col(c).cast("long")).alias(c) for c in COUNTED])


def rolled_up(rows: DataFrame) -> DataFrame:
    """hourly_rows(), or sums of them, as the rollup: a session counts while it has a request in the hour."""
    by_session = rows.groupBy("profile_id", "machine_id", "model", "hour_us", "session_id").agg(*[F.sum(c).alias(c) for c in COUNTED])
    shown = by_session.where("events > 0").groupBy("profile_id", "machine_id", "model", F.timestamp_micros("hour_us").cast("timestamp_ntz").alias("hour"))
    total = F.lit(0)
    for part in TOKEN_PARTS:
        total = total + F.sum(part)
    sums = [F.sum(c).alias(c) for c in (*TOKEN_PARTS, "thinking_tokens")]
    cost = F.when(F.sum("priced") > 0, F.round(F.sum("cost_micro") / 1_000_000, 6))
    return shown.agg((F.first("model") != "<synthetic>").alias("counts_toward_quota"), F.sum("events").alias("events"), F.count("*").alias("sessions"), *sums, total.alias("total_tokens"), cost.alias("cost_usd"), F.sum("unpriced_events").alias("unpriced_events"))


def hourly_view(usage: DataFrame) -> DataFrame:
    """The whole rollup by profile, machine, model and UTC hour of usage(…, cost_usd): all sums, cost, and what has no price.

    Requests that do not count toward the quota stay, marked; cost is null where nothing has a price.
    """
    return rolled_up(hourly_rows(usage))


def models_seen(usage: DataFrame, since_us: int) -> DataFrame:
    return usage.where(F.col("us") >= since_us).groupBy("model").agg(F.count("*").alias("events"), F.max("us").alias("last_us"))


def unpriced_models(seen: DataFrame, catalog: DataFrame) -> DataFrame:
    """Models that neither their name nor their name without suffix finds in the catalog."""
    from meterlark.functions.scalars import normalized_model

    names = F.broadcast(catalog.select(F.col("name")))
    return seen.join(names, seen["model"] == names["name"], "left_anti").join(names, normalized_model() == names["name"], "left_anti")


def usage_totals(usage: DataFrame) -> DataFrame:
    """Totals of each profile with cache hit rate, mean context and mean cost of a call."""
    read, write = F.sum("cache_read_tokens"), F.sum(F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens"))
    context = F.sum("input_tokens") + read + write
    return usage.where(counts_toward_quota()).groupBy("profile_id").agg(
        F.count("*").alias("events"),
        F.sum(quota_tokens()).alias("total_tokens"),
        F.round(F.try_divide(read * 100.0, context), 6).alias("cache_hit_pct"),
        F.round(context / F.count("*"), 4).alias("mean_context"),
        F.round(F.sum("cost_usd"), 6).cast("double").alias("cost_usd"),
        F.count("cost_usd").alias("priced_events"),
        F.round(F.try_divide(F.sum("cost_usd").cast("double"), F.count("cost_usd")), 6).alias("mean_cost"),
    )


def shares(distributed: DataFrame) -> DataFrame:
    """Each key's percentage of all tokens. The frame has one row for each key, so the total is one row too."""
    total = distributed.agg(F.sum("total_tokens").alias("_all"))
    return distributed.crossJoin(F.broadcast(total)).withColumn("share_pct", F.round(F.try_divide(F.col("total_tokens") * 100.0, F.col("_all")), 6)).drop("_all")


def top_n_rest(distributed: DataFrame, n: int, within: str | None = None) -> DataFrame:
    """The n keys with most tokens, and one row `(rest)` for the others."""
    if within:
        rank = F.row_number().over(Window.partitionBy(within).orderBy(F.col("total_tokens").desc(), F.col("key")))
        ranked = distributed.withColumn("_r", rank)
        keys = [F.col(within)]
    else:
        top = distributed.orderBy(F.col("total_tokens").desc(), F.col("key")).limit(n).select(F.col("key").alias("_k"), F.lit(1).alias("_r"))
        ranked = distributed.join(F.broadcast(top), F.col("key") == F.col("_k"), "left").withColumn("_r", F.coalesce("_r", F.lit(n + 1)))
        keys = []
    return ranked.groupBy(*keys, F.when(F.col("_r") <= n, F.col("key")).otherwise("(rest)").alias("key")).agg(F.sum("events").alias("events"), F.sum("total_tokens").alias("total_tokens"))


def heat_grid(usage: DataFrame) -> DataFrame:
    """Tokens by weekday (Monday 0) and hour, all 7 x 24 cells."""
    spark = usage.sparkSession
    cells = spark.range(168).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    sums = usage.where(counts_toward_quota()).groupBy(F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(F.sum(quota_tokens()).alias("total_tokens"), F.count("*").alias("events"))
    return cells.join(sums, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), F.coalesce("events", F.lit(0)).alias("events"))


def cache_trend(usage: DataFrame) -> DataFrame:
    """Share of cache reads in all tokens by hour; hours without tokens are left out."""
    g = usage.where(counts_toward_quota()).groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")).agg(F.sum("cache_read_tokens").alias("r"), F.sum(quota_tokens()).alias("t"))
    return g.where("t > 0").select("hour", F.round(F.col("r") / F.col("t"), 6).alias("cache_share"))


def attribution_shares(usage: DataFrame) -> DataFrame:
    order = F.expr("CASE attribution_level WHEN 'proxy' THEN 0 WHEN 'timeline' THEN 1 WHEN 'fallback' THEN 2 ELSE 3 END")
    return usage.groupBy(order.alias("position"), "attribution_level").agg(F.count("*").alias("events"))


def merge_forks(sessions: DataFrame) -> DataFrame:
    """Sessions with the same title, project and machine count as the earliest of them (the smaller id on a tie).

    A session without a title is one of its own.
    """
    untitled = F.coalesce(F.col("title"), F.lit("")) == ""
    keys = ["title", "project", "machine_id"]
    groups = sessions.groupBy(*keys, F.when(untitled, F.col("session_id")).alias("_own")).agg(F.min_by("session_id", F.struct("first_us", "session_id")).alias("session_id"), F.countDistinct("session_id").alias("members"), F.sum("total_tokens").alias("total_tokens"))
    return groups.drop("_own")


def treemap_areas(distributed: DataFrame, floor: float = 0.02, most: float = 0.25) -> DataFrame:
    """Areas in tokens: each key's own, but at least `floor` of all, and a thousandth of its own more to keep the order.

    Keys below the floor together take at most `most` of all; where they would take more, the floor is shared out
    among them. Without tokens every area is 1.
    """
    total = distributed.agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("double").alias("_all"))
    small = distributed.crossJoin(F.broadcast(total)).where(F.col("total_tokens") < floor * F.col("_all")).agg(F.count("*").alias("_small"))
    least = F.when(F.col("_small") * floor > most, F.lit(most) / F.col("_small")).otherwise(floor) * F.col("_all")
    both = distributed.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(small))
    area = F.when(F.col("_all") <= 0, 1.0).otherwise(F.greatest(F.col("total_tokens").cast("double"), least) + F.col("total_tokens") * 1e-3)
    return both.select("key", F.round(area, 4).alias("area"))


def scratch_labels(usage: DataFrame) -> DataFrame:
    """For each project the session with most tokens and the number of sessions."""
    by = usage.where("project IS NOT NULL").groupBy("project", "session_id").agg(F.sum(quota_tokens()).alias("t"))
    return by.groupBy("project").agg(F.max_by("session_id", F.struct("t", "session_id")).alias("top_session"), F.count("*").alias("sessions"))
