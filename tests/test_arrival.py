"""Samples of equal moments are read in the order of their arrival."""

import pytest

from meterlark.plans import registry

DAY = 86_400_000_000


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Three hours of samples, two a moment, so that the fall after every 17th sample lies inside one."""
    from pyspark.sql import functions as F

    rows = spark.range(0, 400).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(19_000 * DAY) + F.floor(F.col("id") / 2) * 60_000_000).cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    )
    folder = tmp_path_factory.mktemp("tied")
    # The latest first: what comes first in the file is not what arrived first.
    rows.orderBy(F.col("event_id").desc()).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def _samples(step):
    """(us, pct) by profile and window of five hours or a week, in order of arrival."""
    found: dict[str, list] = {}
    for i in range(400):
        found.setdefault(f"p{i // 2 % 2}", []).append(19_000 * DAY + i // 2 * 60_000_000)
    return {p: [(us, n % 17 * step) for n, us in enumerate(times)] for p, times in found.items()}


def _peaks(pcts):
    """The sum of the peaks between falls of two points or more, and the number of these falls."""
    total, top, falls, last = 0.0, 0.0, 0, 0.0
    for pct in pcts:
        if last - pct >= 2:
            total, top, falls = total + top, 0.0, falls + 1
        top, last = max(top, pct), pct
    return total + top, falls


def test_periods_of_equal_moments_in_any_order(spark):
    from meterlark.operators.ledger import periods

    rows = [("p", "k", us, pct, 100 * DAY, n) for n, (us, pct) in enumerate([(1, 6.0), (1, 0.0), (1, 3.0), (2, 9.0), (2, 0.0), (3, 4.0)])]
    schema = "profile_id string, window_kind string, us long, pct double, resets_us long, n long"
    found = lambda **more: {tuple(periods(spark.createDataFrame(rows[k:] + rows[:k], schema), **more).select("cumulative_pct", "resets").first()) for k in (0, 1, 2)}
    # 0 3 6 | 0 9 | 4, and as they arrived 6 | 0 3 9 | 0 4
    assert found() == {(19.0, 2)} and found(ties=["n"]) == {(19.0, 2)}
    rows[0], rows[2] = (*rows[0][:3], 3.0, *rows[0][4:]), (*rows[2][:3], 6.0, *rows[2][4:])
    # 3 | 0 6 9 | 0 4
    assert found(ties=["n"]) == {(16.0, 2)}


@pytest.mark.parametrize("name", ["window_identity", "reset_segments"])
def test_windows_by_arrival(spark, tied, name):
    found = {(r["profile_id"], r["window_kind"]): (r["cumulative_pct"], r["resets"]) for r in registry.queries()[name](spark, tied).collect()}
    assert found == {(p, kind): _peaks([pct for _, pct in rows]) for kind, step in (("five_hour", 3.0), ("seven_day", 0.5)) for p, rows in _samples(step).items()}


def test_every_pair_of_a_moment_counts(spark, tied):
    short, long = _samples(3.0), _samples(0.5)
    expected = {}
    for p in short:
        pairs = [(us, a, b) for us, a in short[p] for at, b in long[p] if at == us]
        segments = [[pairs[0]]]
        for before, pair in zip(pairs, pairs[1:]):
            if pair[1] < before[1] or pair[2] < before[2]:
                segments.append([])
            segments[-1].append(pair)
        expected[p] = (sum(s[-1][1] - s[0][1] for s in segments), sum(s[-1][2] - s[0][2] for s in segments), len(segments))
    found = registry.queries()["limit_ratio"](spark, tied).collect()
    assert {r["profile_id"]: (r["short_pct"], r["long_pct"], r["segments"]) for r in found} == expected
