"""The second ledger: quota periods with resets, and usage totals with coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.operators.ordered import MINUTE_US
from meterlark.operators.scan import Scan


def exclusive_counters(df: DataFrame) -> DataFrame:
    """Inclusive counters (cached and cache-write lie inside input) as exclusive ones."""
    rest = F.greatest(F.lit(0), F.col("input_tokens") - F.col("cached_tokens") - F.col("cache_write_tokens"))
    return df.withColumn("uncached_tokens", rest)


def priced(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """df with cost_usd and missing_reason; catalog(model, input, cached, cache_write, output, long_over, long_input, long_output)."""
    j = df.join(F.broadcast(catalog.withColumn("_known", F.lit(True))), "model", "left")
    fits = (F.col("cached_tokens") + F.col("cache_write_tokens") <= F.col("input_tokens")) & (F.col("reasoning_tokens") <= F.col("output_tokens"))
    long = F.col("long_over").isNotNull() & (F.col("input_tokens") > F.col("long_over"))
    m_in, m_out = F.when(long, F.col("long_input")).otherwise(1.0), F.when(long, F.col("long_output")).otherwise(1.0)
    reason = (
        F.when(F.col("_known").isNull(), "unknown_model")
        .when(~fits, "invalid_partition")
        .when((F.col("cache_write_tokens") > 0) & F.col("cache_write").isNull(), "unknown_cache_write_price")
    )
    uncached = F.col("input_tokens") - F.col("cached_tokens") - F.col("cache_write_tokens")
    write = F.when(F.col("cache_write_tokens") == 0, 0.0).otherwise(F.col("cache_write_tokens") * F.col("cache_write"))
    cost = ((uncached * F.col("input") + F.col("cached_tokens") * F.col("cached") + write) * m_in + F.col("output_tokens") * F.col("output") * m_out) / 1e6
    return j.withColumns({"missing_reason": reason, "cost_usd": F.when(reason.isNull(), F.round(cost.cast("decimal(20,9)"), 6))}).drop("_known", *[c for c in catalog.columns if c != "model"])


def usage_coverage(df: DataFrame, by: Sequence[Column] = ()) -> DataFrame:
    """Totals with what share of tokens has a price and why the rest has none."""
    tokens = F.col("input_tokens") + F.col("output_tokens")
    return df.groupBy(*by).agg(
        F.count("*").alias("events"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 6).cast("double").alias("cost_usd"),
        F.count("cost_usd").alias("priced_events"),
        F.round(F.try_divide(F.sum(F.when(F.col("cost_usd").isNotNull(), tokens)) * 100.0, F.sum(tokens)), 4).alias("coverage_pct"),
        F.count_if(F.col("missing_reason") == "unknown_model").alias("unknown_model"),
    )


DIMENSIONS = ("day", "model", "machine", "project", "session")


def usage_buckets(df: DataFrame, zone: str = "UTC") -> DataFrame:
    """(dimension, key, …): totals by local day, model, machine, project and session, and in all, from one pass over df.

    df(us, model, machine_id, project, session_id, input_tokens, output_tokens, cost_usd). The sets are grouped
    together: one scan, one shuffle of partial sums.
    """
    unknown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(unknown)"))
    day = F.date_format(F.from_utc_timestamp(F.timestamp_micros("us"), zone), "yyyy-MM-dd")
    named = df.select(day.alias("day"), unknown("model").alias("model"), unknown("machine_id").alias("machine"), unknown("project").alias("project"), unknown("session_id").alias("session"), "input_tokens", "output_tokens", "cost_usd")
    tokens = F.col("input_tokens") + F.col("output_tokens")
    dimension, key = F.lit("total"), F.lit(None).cast("string")
    for name in DIMENSIONS:
        dimension, key = F.when(F.grouping(name) == 0, name).otherwise(dimension), F.when(F.grouping(name) == 0, F.col(name)).otherwise(key)
    sums = named.groupingSets([[F.col(d)] for d in DIMENSIONS] + [[]], *[F.col(d) for d in DIMENSIONS]).agg(
        dimension.alias("dimension"), key.alias("key"), F.count("*").alias("events"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 6).cast("double").alias("cost_usd"), F.count("cost_usd").alias("priced_events"),
        F.round(F.try_divide(F.sum(F.when(F.col("cost_usd").isNotNull(), tokens)) * 100.0, F.sum(tokens)), 4).alias("coverage_pct"),
    )
    return sums.drop(*DIMENSIONS)


def periods(history: DataFrame, keys: Sequence[str] = ("profile_id", "window_kind"), drop: float = 2.0, gap_us: int = 30 * MINUTE_US, moved_us: int = 10 * MINUTE_US, ties: Sequence[str] = ("pct",)) -> DataFrame:
    """Billing periods of a quota history(keys, us, pct, resets_us): one row for each period.

    A new period opens when the sample reaches the old deadline with a later one, or when usage falls and the
    deadline moves at once; a fall under the same deadline opens a segment. All conditions compare neighbours; equal moments are in the order of
    ties, the lower first.
    """
    moved = F.coalesce(F.abs(F.col("resets_us") - F.col("_r")) > moved_us, F.lit(False))
    dropped = F.coalesce(F.col("_p") - F.col("pct") >= drop, F.lit(False))
    scheduled = moved & F.coalesce(F.col("us") >= F.col("_r"), F.lit(False))
    fresh = scheduled | (dropped & moved)
    cut = Scan(history, keys, ties=ties).runs({"_u": "us", "_p": "pct", "_r": "resets_us"}, period=fresh, _falls=dropped & ~fresh).frame()
    gap = ~fresh & (F.col("us") - F.col("_u") > gap_us)
    # A period opens without a fall of its own, so the falls of its rows less those of its first row number its segments.
    peaks = cut.withColumn("_gap", gap).groupBy(*keys, "period", "_falls").agg(F.max("pct").alias("peak"), F.min("us").alias("a"), F.max("us").alias("b"), F.count("*").alias("n"), F.max_by("resets_us", "us").alias("r"), F.bool_or(F.coalesce("_gap", F.lit(False))).alias("g"))
    return peaks.groupBy(*keys, "period").agg(
        F.min("a").alias("first_us"),
        F.max("b").alias("last_us"),
        F.sum("n").alias("samples"),
        F.round(F.sum("peak"), 6).alias("cumulative_pct"),
        (F.max("_falls") - F.min("_falls")).alias("resets"),
        F.max_by("r", "b").alias("resets_us"),
        F.bool_or("g").alias("has_gap"),
    )
