"""The sampling schedule: its rules, the closed form against the fold, and the stream with its timers against both."""

import random

import pandas as pd
import pytest

from meterlark.streaming import sampling as s
from meterlark.streaming.pipelines import write_stream

SCHEMA = "profile_id string, us long, outcome string, pcts map<string,double>"


def _rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def _attempts(seed, n=300):
    rng = random.Random(seed)
    rows, at, pct = [], {"a": 0, "b": 0, "c": 10**12}, 5.0
    for _ in range(n):
        key = rng.choice("aab")
        at[key] += rng.randrange(1, 400) * 10**6 * rng.choice([1, 1, 500])
        pct += rng.choice([0, 0, 0, 0, 1])
        outcome = rng.choice(["ok"] * 8 + ["auth", "auth", "blocked", "error", "org"])
        rows.append((key, at[key], outcome, {"five_hour": pct, **({"seven_day": 1.0} if rng.random() < 0.5 else {})} if outcome == "ok" else None))
    return [*rows, ("c", 10**12, "error", None)]


def _folded(rows):
    states, out = {}, []
    for key, us, outcome, pcts in sorted(rows, key=lambda r: (r[0], r[1])):
        state = states.setdefault(key, s.fresh_state())
        wait = s.decide(state, outcome, pcts or {})
        out.append((key, us, outcome, state["interval"], state["failures"], us + wait * 1000))
    return sorted(tuple(str(x) for x in r) for r in out)


def test_rules():
    state = s.fresh_state()
    assert [s.decide(state, "ok", {"w": 1.0}) for _ in range(8)] == [10_000, 20_000, 40_000, 80_000, 160_000, 300_000, 300_000, 300_000]
    assert s.decide(state, "ok", {"w": 2.0}) == 10_000 and s.decide(state, "ok", {"other": 9.0}) == 20_000
    assert [s.decide(state, "auth", {}) for _ in range(4)] == [900_000, 3_600_000, 21_600_000, 21_600_000] and s.decide(state, "error", {}) == 300_000
    assert s.decide(state, "ok", {"other": 9.0}) == 40_000 and state["failures"] == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closed_form_equals_the_fold(spark, seed):
    rows = _attempts(seed)
    found = s.decisions(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert _rows(found.select("profile_id", "us", "outcome", "interval_ms", "failures", "next_us")) == _folded(rows)


def test_stream_equals_the_fold(spark, tmp_path):
    rows = sorted(_attempts(4, 60), key=lambda r: r[1])
    # A query with timers of the clock has batches without data for ever; without them it ends with its input.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for part in range(3):
            spark.createDataFrame(rows[part * 21 : (part + 1) * 21], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/part{part}"))
            query = write_stream(s.schedule(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in/*"))), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
            ended = query.awaitTermination(60)
            query.stop()
            assert ended
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    out = spark.read.parquet(str(tmp_path / "out")).drop("epoch")
    assert _rows(out.where("change = 'decided'").drop("change")) == _folded(rows)


class _Held:
    """A state handle in memory, with timers."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)

    def listTimers(self):
        return iter(self.timers)


def test_one_timer_stands_for_the_next_attempt():
    clock = type("Clock", (), {"now": 5_000, "getCurrentProcessingTimeInMs": lambda self: self.now})()
    held, machine = _Held(), s.Schedule(s.SHORTEST_MS, s.LONGEST_MS, s.LADDER_MS)
    machine.init(held)
    attempt = lambda us, outcome="ok", pct=1.0: list(machine.handleInputRows(("a",), iter([pd.DataFrame([(us, outcome, {"w": pct})], columns=["us", "outcome", "pcts"])]), clock))[0]
    assert attempt(5_000_000)["next_us"].tolist() == [15_000_000] and held.timers == {15_000}
    assert attempt(9_000_000)["next_us"].tolist() == [29_000_000] and held.timers == {29_000}  # it comes early and moves the timer
    due = list(machine.handleExpiredTimer(("a",), clock, None))[0]
    assert due[["us", "change", "interval_ms"]].values.tolist() == [[29_000_000, "due", 20_000]]
    clock.now = 10**9  # recorded moments lie in the past: due at once
    attempt(30_000_000, "auth")
    assert held.timers == {10**9 + 1}
