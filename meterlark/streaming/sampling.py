"""When to ask for a quota next: a schedule kept as state, in batch over recorded attempts and in a stream with timers.

After an attempt that shows a change, or the first one, a series is asked again after the shortest interval; each
unchanged one doubles it up to the longest. An attempt that is refused backs off by a ladder, the last rung for all
further ones, until one succeeds; any other failure waits the longest interval. Failures leave the interval of
successes as it is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from meterlark.operators.scan import Scan
from meterlark.streaming.pipelines import stateful

#: Intervals and the ladder of refused attempts, in milliseconds (fixed values).
SHORTEST_MS, LONGEST_MS = 10_000, 300_000
LADDER_MS = (900_000, 3_600_000, 21_600_000)
#: Outcomes of an attempt: ok carries percentages; refused ones climb the ladder.
REFUSED = ("auth", "blocked")
DECISION = "us long, outcome string, interval_ms long, failures long, next_us long, change string"


def decide(state: dict, outcome: str, pcts: dict[str, float], shortest: int = SHORTEST_MS, longest: int = LONGEST_MS, ladder: tuple[int, ...] = LADDER_MS) -> int:
    """How long to wait after an attempt, in milliseconds; state(interval, failures, pcts) follows it."""
    if outcome == "ok":
        before = state["pcts"]
        changed = before is None or any(k in before and before[k] != v for k, v in pcts.items())
        state["interval"] = shortest if changed else min(2 * state["interval"], longest)
        state["pcts"], state["failures"] = pcts, 0
        return state["interval"]
    if outcome in REFUSED:
        state["failures"] += 1
        return ladder[min(state["failures"], len(ladder)) - 1]
    return longest


def fresh_state(shortest: int = SHORTEST_MS) -> dict:
    return {"interval": shortest, "failures": 0, "pcts": None}


def decisions(attempts: DataFrame, shortest: int = SHORTEST_MS, longest: int = LONGEST_MS, ladder: tuple[int, ...] = LADDER_MS) -> DataFrame:
    """attempts(profile_id, us, outcome, pcts map<string,double>) with interval_ms, failures and next_us, in closed form.

    A success in a row of unchanged ones waits the shortest interval times two to its place in the row; the failures
    of a refused one are those since the last success. One scan over the successes, one over all.
    """
    ok = F.col("outcome") == "ok"
    differs = F.exists(F.map_keys("pcts"), lambda k: F.element_at("_before", k).isNotNull() & (F.element_at("pcts", k) != F.element_at("_before", k)))
    good = Scan(attempts.where(ok).select("profile_id", "us", "pcts"), ["profile_id"]).runs({"_before": "pcts"}, _changes=F.coalesce(differs, F.lit(False))).running(_n=F.lit(1).cast("long")).frame()
    firsts = good.groupBy("profile_id", "_changes").agg(F.min("_n").alias("_first"))
    # Doubling ends where the longest interval is reached, so the exponent stays small.
    steps = F.least(F.col("_n") - F.col("_first"), F.lit(62 - shortest.bit_length()))
    timed = good.join(firsts, ["profile_id", "_changes"]).select("profile_id", "us", F.least(F.lit(longest), F.lit(shortest) * F.pow(F.lit(2), steps).cast("long")).alias("_held"))
    refused = F.col("outcome").isin(*REFUSED)
    all_ = Scan(attempts.join(timed, ["profile_id", "us"], "left"), ["profile_id"]).running(_bad=F.when(refused, F.lit(1).cast("long")).otherwise(0)).derive(_at=F.when(ok, F.col("_bad"))).last(_since="_at", _interval="_held").frame()
    failures = F.when(ok, 0).otherwise(F.col("_bad") - F.coalesce("_since", F.lit(0)))
    rung: Column = F.element_at(F.array(*[F.lit(x).cast("long") for x in ladder]), F.least(failures, F.lit(len(ladder))).cast("int"))
    wait = F.when(ok, F.col("_interval")).when(refused, rung).otherwise(F.lit(longest).cast("long"))
    return all_.select("profile_id", "us", "outcome", F.coalesce("_interval", F.lit(shortest)).cast("long").alias("interval_ms"), failures.cast("long").alias("failures"), (F.col("us") + wait * 1000).alias("next_us"))


class Schedule(StatefulProcessor):
    """The schedule of a series: a decision for each attempt, and `due` when its time has come by the clock.

    A timer stands for the next attempt; an attempt that comes earlier moves it.
    """

    def __init__(self, shortest: int, longest: int, ladder: tuple[int, ...]):
        self.rules = (shortest, longest, ladder)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("schedule", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else {**fresh_state(self.rules[0]), "next": None}
        out = []
        for us, outcome, pcts in pd.concat(list(rows)).sort_values("us", kind="stable")[["us", "outcome", "pcts"]].itertuples(index=False, name=None):
            wait = decide(held, outcome, {k: float(v) for k, v in dict(pcts or {}).items()}, *self.rules)
            held["next"] = int(us) + wait * 1000
            out.append((key[0], int(us), outcome, held["interval"], held["failures"], held["next"], "decided"))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        # A moment that has passed is due at once.
        self.handle.registerTimer(max(held["next"] // 1000, timerValues.getCurrentProcessingTimeInMs() + 1))
        self.state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["profile_id", *(c.split()[0] for c in DECISION.split(", "))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0])
        yield pd.DataFrame([(key[0], held["next"], "due", held["interval"], held["failures"], held["next"], "due")], columns=["profile_id", *(c.split()[0] for c in DECISION.split(", "))])

    def close(self) -> None:
        pass


def schedule(attempts: DataFrame, shortest: int = SHORTEST_MS, longest: int = LONGEST_MS, ladder: tuple[int, ...] = LADDER_MS) -> DataFrame:
    """A stream of attempts as decisions (change = decided) and as calls for the next attempt (change = due).

    Timers follow the clock, so a query over it runs on until it is stopped; give it an interval.
    """
    return stateful(attempts).groupBy("profile_id").transformWithStateInPandas(Schedule(shortest, longest, ladder), f"profile_id string, {DECISION}", "Update", "ProcessingTime")
