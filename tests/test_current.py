"""Window identity by nearness and the parts of the whole current state, on series made for them."""

import random

import pytest
from pyspark.sql import functions as F

from meterlark.operators import current, ordered

MIN, HOUR = 60_000_000, 3_600_000_000
NOW = 1_706_000_000_000_000


def _rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def _samples(spark, rows):
    return spark.createDataFrame(rows, "profile_id string, window_kind string, us long, pct double, resets_us long")


def test_jitter_makes_no_windows(spark):
    random.seed(9)
    plain = []
    for w in range(6):
        end = NOW + w * 5 * HOUR
        plain += [("p", "five_hour", end - 5 * HOUR + k * 7 * MIN + 10 * MIN, float(k % 23), end) for k in range(40)]
    jitter = [(p, k, us, pct, end + random.randrange(-4_000_000, 4_000_000) if random.random() < 0.8 else None) for p, k, us, pct, end in plain]
    exact = ordered.cumulative_usage(_samples(spark, plain), ["profile_id", "window_kind", "resets_us"])
    named = current.identify_windows(_samples(spark, jitter))
    assert named.count() == len(plain)
    found = ordered.cumulative_usage(named.where("window_us IS NOT NULL"), ["profile_id", "window_kind", "window_us"])
    assert found.count() == exact.count() == 6
    whole = lambda df: _rows(df.select("cumulative_pct", "resets", "current_start_us", "last_pct"))
    first_known = [r["us"] for r in named.where("window_us IS NULL").collect()]
    assert whole(found) == whole(exact) or first_known  # samples before the first reset of a window belong to none
    off = named.join(_samples(spark, plain).withColumnRenamed("resets_us", "end_us").select("us", "end_us"), "us").where(F.abs(F.col("window_us") - F.col("end_us")) > 4_000_000)
    assert off.count() == 0


def test_chain_and_distance(spark):
    at = [0, 9 * MIN, 18 * MIN, 29 * MIN, 5 * HOUR]
    rows = [("p", "five_hour", NOW + i, 1.0, NOW + HOUR + a) for i, a in enumerate(at)] + [("p", "five_hour", NOW + 10, 1.0, None), ("p", "five_hour", NOW - 10, 1.0, None), ("p", "five_hour", NOW + 7 * HOUR, 1.0, None), ("q", "five_hour", NOW, 1.0, NOW)]
    found = {(r["profile_id"], r["us"]): r["window_us"] for r in current.identify_windows(_samples(spark, rows)).collect()}
    assert {found["p", NOW + i] for i in range(3)} == {NOW + HOUR + 18 * MIN}
    assert found["p", NOW + 3] == NOW + HOUR + 29 * MIN and found["p", NOW + 4] == found["p", NOW + 10] == NOW + 6 * HOUR
    assert found["p", NOW - 10] is None and found["p", NOW + 7 * HOUR] is None and found["q", NOW] == NOW


def test_a_window_opened_early_starts_after_the_old_one(spark):
    """89 and 91 of the old window, then 3 of the new one: its end is later, its nominal start lies in the old one."""
    end = NOW + 4 * HOUR
    rows = [("p", "five_hour", NOW - 40 * MIN, 89.0, NOW + HOUR), ("p", "five_hour", NOW - 20 * MIN, 91.0, NOW + HOUR), ("p", "five_hour", NOW - 10 * MIN, 3.0, end)]
    latest = current.latest_windows(_samples(spark, rows), NOW)
    own, bounded = current.own_samples(_samples(spark, rows), latest)
    assert [r["pct"] for r in own.collect()] == [3.0] and bounded.first()["start_us"] == NOW - 20 * MIN


@pytest.fixture(scope="module")
def state(spark):
    end = NOW + 2 * HOUR
    pct = [0, 2, 4, 4, 7, 8, 1, 2]
    samples = [("p", "five_hour", NOW - 70 * MIN + i * 10 * MIN, float(v), end + i * 1000) for i, v in enumerate(pct)]
    samples += [("p", "seven_day", NOW - 70 * MIN + i * 10 * MIN, 20.0 + i, end + 3 * 24 * HOUR) for i in range(8)]
    events = [("p", NOW - 66 * MIN, "m1", "s1", 100, 1.5, True), ("p", NOW - 64 * MIN, "m2", "s1", 50, 2.5, True), ("p", NOW - 12 * MIN, "m1", "s2", 10, 0.5, None), ("p", NOW - 5 * HOUR, "m1", "s2", 10, 0.5, None)]
    used = spark.createDataFrame(events, "profile_id string, us long, machine_id string, session_id string, tokens long, cost_usd double, output_final boolean").withColumn("cost_usd", F.col("cost_usd").cast("decimal(20,9)"))
    shares = spark.createDataFrame([("p", NOW - 3 * HOUR, 10.0, 20.0, NOW - 4 * 24 * HOUR), ("p", NOW - 15 * MIN, 27.0, 10.0, NOW - 4 * 24 * HOUR)], "profile_id string, us long, weekly_pct double, share_pct double, week_start_us long")
    return {r["window_kind"]: r for r in current.window_states(_samples(spark, samples), used, shares, NOW).collect()}


def test_state_of_a_short_window(state):
    r = state["five_hour"]
    assert (r["pct"], r["cumulative_pct"], r["resets"], r["waste_pct"], r["label"], r["stale"]) == (2.0, 10.0, 1, 98.0, "5h", False)
    # Rises of 2 and 2 lie beside the events of the first minutes, 3 and 1 in silence, the last 1 beside the late event.
    assert (r["observed_pct"], r["ambiguous_pct"], r["other_lower_pct"], r["quiet_spans"], r["has_gap"], r["usable"]) == (9.0, 5.0, 4.0, 2, False, True)
    assert (r["machines"], r["events"], r["tokens"]) == ("m1,m2", 3, 160)
    assert r["cut_rate"] == 0.5 and r["reference_usd"] is None and r["other_pct"] == 4.0 and r["local_pct"] == 6.0


def test_state_of_a_long_window_takes_product_shares(state):
    r = state["seven_day"]
    # 2 points of others at the first breakdown, 2.7 at the second; the first one's week began before the window.
    assert r["noncode_pct"] == pytest.approx(0.7, abs=2.1) and r["usable"] and r["other_pct"] == r["noncode_pct"] and r["machines"] is None
    assert r["cumulative_pct"] == 27.0 and r["local_pct"] == pytest.approx(27.0 - r["other_pct"])
