"""Calendar-aware weights: how usage spreads over weekdays, and how much of it a span holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def weekday_weights(events: DataFrame, key: str = "profile_id", least_days: int = 7) -> DataFrame:
    """(key, weekday Sunday 0, weight): mean tokens of a weekday over the mean of the weekdays seen, within [0.1, 5].

    Weekdays without a day weigh 1; a key with fewer than least_days days, or without tokens, weighs 1 throughout.
    """
    days = events.groupBy(key, F.floor(F.col("us") / DAY_US).alias("day")).agg(F.sum("tokens").alias("t"))
    by = days.withColumn("weekday", ((F.col("day") + 4) % 7).cast("int")).groupBy(key, "weekday").agg(F.avg("t").alias("m"), F.count("*").alias("n"))
    overall = by.groupBy(key).agg(F.avg("m").alias("all"), F.sum("n").alias("days"))
    grid = overall.select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday")).join(by.select(key, "weekday", "m"), [key, "weekday"], "left")
    known = (F.col("days") >= least_days) & (F.col("all") > 0) & F.col("m").isNotNull()
    return grid.select(key, "weekday", F.round(F.when(known, F.greatest(F.lit(0.1), F.least(F.lit(5.0), F.col("m") / F.col("all")))).otherwise(1.0), 6).alias("weight"))


def calendar_weight(spans: DataFrame, weights: DataFrame, key: str = "profile_id") -> DataFrame:
    """(key, from_us, to_us, weight): the sum over days of the part of the day inside the span times its weekday's weight."""
    days = spans.withColumn("day", F.explode(F.sequence(F.floor(F.col("from_us") / DAY_US), F.floor((F.col("to_us") - 1) / DAY_US))))
    part = (F.least(F.col("to_us"), (F.col("day") + 1) * DAY_US) - F.greatest(F.col("from_us"), F.col("day") * DAY_US)) / F.lit(float(DAY_US))
    each = days.withColumn("weekday", ((F.col("day") + 4) % 7).cast("int")).withColumn("_part", part)
    return each.join(weights, [key, "weekday"]).groupBy(key, "from_us", "to_us").agg(F.round(F.sum(F.col("_part") * F.col("weight")), 5).alias("weight"))


def calendar_projection(windows: DataFrame, weights: DataFrame, now_us: int, key: str = "profile_id") -> DataFrame:
    """Projection of long windows by weekday: points used per weighted day so far, times the weighted days left.

    windows(key, start_us, end_us, last_pct, cumulative_pct, rate, low, high): one row for each key, rates as of
    ordered.recent_rates; their quartiles over their mean are the band around the middle. A key without weights
    weighs 1 throughout. eta_ms is when the weighted days left reach what is missing, null unless before the end.
    """
    day, now = F.col("day") * DAY_US, F.lit(now_us)
    part = lambda a, b: F.greatest(F.least(b, day + DAY_US) - F.greatest(a, day), F.lit(0)) / F.lit(float(DAY_US))
    days = windows.withColumn("day", F.explode(F.sequence(F.floor(F.col("start_us") / DAY_US), F.floor((F.col("end_us") - 1) / DAY_US))))
    days = days.withColumn("weekday", ((F.col("day") + 4) % 7).cast("int")).join(weights, [key, "weekday"], "left").withColumn("_w", F.coalesce("weight", F.lit(1.0)))
    days = days.withColumns({"_gone": part(F.col("start_us"), F.least(now, F.col("end_us"))) * F.col("_w"), "_left": part(F.greatest(now, F.col("start_us")), F.col("end_us")) * F.col("_w")})
    w = Window.partitionBy(key)
    missing = (100 - F.col("last_pct")) * F.col("_elapsed") / F.col("cumulative_pct")
    days = days.withColumns({"_elapsed": F.sum("_gone").over(w), "_remaining": F.sum("_left").over(w), "_before": F.sum("_left").over(w.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))})
    days = days.withColumn("_before", F.coalesce("_before", F.lit(0.0))).withColumn("_missing", F.when((F.col("cumulative_pct") > 0) & (F.col("last_pct") < 100) & (F.col("_elapsed") > 0), missing))
    # The day in which the weighted days left reach what is missing.
    reached = (F.col("_left") > 0) & (F.col("_missing") > F.col("_before")) & (F.col("_missing") <= F.col("_before") + F.col("_left"))
    at = F.greatest(now, day, F.col("start_us")) + (F.col("_missing") - F.col("_before")) / F.col("_w") * DAY_US
    same = ["start_us", "end_us", "last_pct", "cumulative_pct", "rate", "low", "high", "_elapsed", "_remaining"]
    one = days.groupBy(key).agg(*[F.first(c).alias(c) for c in same], F.min(F.when(reached, F.floor(at / 1000 + 0.5))).alias("eta_ms"))
    moving = (F.col("_elapsed") > 0) & (F.col("_remaining") > 0)
    rise = F.when(moving, F.col("cumulative_pct") / F.col("_elapsed") * F.col("_remaining")).otherwise(0.0)
    k25 = F.when(F.col("rate") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("low") / F.col("rate")))).otherwise(1.0)
    k75 = F.when(F.col("rate") > 0, F.greatest(F.lit(1.0), F.col("high") / F.col("rate"))).otherwise(1.0)
    clamp = lambda x: F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))
    mid, minutes = clamp(F.col("last_pct") + rise), (F.col("end_us") - now) / 60_000_000
    return one.select(
        key,
        F.col("end_us").alias("resets_us"),
        F.round(F.when(moving & (minutes > 0), (mid - F.col("last_pct")) / minutes).otherwise(0.0), 6).alias("rate"),
        F.round(mid, 4).alias("mid_pct"),
        F.round(clamp(F.col("last_pct") + k25 * rise), 4).alias("lo_pct"),
        F.round(clamp(F.col("last_pct") + k75 * rise), 4).alias("hi_pct"),
        "eta_ms",
    )
