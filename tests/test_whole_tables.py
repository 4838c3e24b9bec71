"""Usage queries over whole tables, and their operators on small series."""

from pyspark.sql import functions as F

from meterlark.operators import attribution, calendar
from meterlark.plans import usage_queries as q

SF_DIR = "/root/testdata/sf0.001"
MINUTE = 60_000_000


def test_every_counted_event_is_placed(spark):
    counted = q._tokens(spark, SF_DIR).select("event_id")
    placed = q.timeline_asof(spark, SF_DIR)
    assert placed.count() == counted.count() and counted.join(placed, "event_id", "left_anti").count() == 0


def test_every_counted_event_makes_a_span_busy(spark):
    counted = q._tokens(spark, SF_DIR).select("profile_id", "us")
    samples = q._quota(spark, SF_DIR, "five_hour")
    s = samples.select("profile_id", F.col("us").alias("at"), "pct").toPandas().sort_values(["profile_id", "at"], kind="stable")
    e = {p: sorted(g["us"]) for p, g in counted.toPandas().groupby("profile_id")}
    for row in q.quiet_attribution(spark, SF_DIR).collect():
        own = s[s["profile_id"] == row["profile_id"]]
        at, pct, quiet = own["at"].tolist(), own["pct"].tolist(), 0
        for i in range(1, len(at)):
            if at[i] - at[i - 1] <= 30 * MINUTE and pct[i] > pct[i - 1]:
                quiet += not any(at[i] - 30 * MINUTE <= u < at[i] for u in e[row["profile_id"]])
        assert row["quiet_spans"] == quiet


def test_quiet_spans(spark):
    samples = spark.createDataFrame([("p", i * 20 * MINUTE, float(i)) for i in range(1, 7)], "profile_id string, us long, pct double")
    events = spark.createDataFrame([("p", 25 * MINUTE), ("p", 110 * MINUTE)], "profile_id string, us long")
    row = attribution.quiet_attribution(samples, events).first()
    # Samples at 40 (event 15 minutes before) and 120 (10 minutes before) are busy; those at 60, 80 and 100 are not.
    assert (row["observed_pct"], row["ambiguous_pct"], row["other_pct"], row["quiet_spans"]) == (5.0, 2.0, 3.0, 3)


def test_long_windows_are_projected_by_weekday(spark):
    """Against a fold over days and 60 bisections of the time left."""
    day, week = calendar.DAY_US, [0.5, 1.0, 2.0, 1.0, 1.0, 0.25, 0.1]
    start, end, now = 20_000 * day + day // 3, 20_007 * day + day // 3, 20_003 * day + day // 2
    weights = spark.createDataFrame([("p", i, x) for i, x in enumerate(week)], "profile_id string, weekday int, weight double")

    def weight(a, b):
        return sum(max(0, min(b, (d + 1) * day) - max(a, d * day)) / day * week[(d + 4) % 7] for d in range(a // day, b // day + 1))

    for last, used, rate, low, high in ((10.0, 30.0, 2.0, 1.0, 5.0), (20.0, 250.0, 0.0, 0.0, 0.0), (50.0, 90.0, 1.0, 3.0, 0.5)):
        windows = spark.createDataFrame([("p", start, end, last, used, rate, low, high)], "profile_id string, start_us long, end_us long, last_pct double, cumulative_pct double, rate double, low double, high double")
        row = calendar.calendar_projection(windows, weights, now).first()
        per = used / weight(start, now)
        rise = per * weight(now, end)
        k25, k75 = (min(1, low / rate), max(1, high / rate)) if rate else (1, 1)
        assert [row["mid_pct"], row["lo_pct"], row["hi_pct"]] == [round(min(100, last + k * rise), 4) for k in (1, k25, k75)]
        a, b = now, end
        for _ in range(60):
            a, b = ((a + b) // 2, b) if weight(now, (a + b) // 2) < (100 - last) / per else (a, (a + b) // 2)
        assert row["eta_ms"] is None if last + rise < 100 else abs(row["eta_ms"] - b / 1000) <= 1
