"""Session rollouts of the second ledger: a state machine over the lines of a file that gives usage events.

A rollout reports cumulative totals and the usage of the last request. Only the latter is ever billed: a growth of
the totals may span requests that other files report too. Whatever may have been lost is kept as a quality flag of
the next event, and as a warning of the line.

The machine holds a few names, counters and flags for a file, so lines stream through it: in batch over sorted
partitions (`parse_rollouts`), in a stream with its state as JSON (`RolloutProcessor`).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of a request (names of the format) and the prefix of event ids (fixed values).
COUNTERS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
REQUIRED = ("input_tokens", "output_tokens")
MAIN = ("input_tokens", "output_tokens", "total_tokens")
ID_PREFIX = "codex:v1:"
SAFE = (1 << 53) - 1
#: Flags that describe one event and say nothing about what lies around it (fixed values).
OWN_FLAGS = frozenset({
    "model_unknown", "turn_id_unavailable", "total_tokens_derived", "total_tokens_mismatch", "input_subsets_exceed_total", "reasoning_exceeds_output",
    "last_usage_only", "counter_detail_baseline_changed", "missing_required_counter", "invalid_counter", "counter_overflow",
})
CONTEXT = ("model", "model_provider", "reasoning_effort", "service_tier", "project")
EVENT_SCHEMA = (
    "path string, ordinal long, event_id string, session_id string, parent_session_id string, turn_id string, us long, model string, model_provider string, reasoning_effort string, service_tier string, project string, "
    + ", ".join(f"{c} long" for c in COUNTERS)
    + ", flags array<string>, warnings array<string>, withheld array<string>"
)
EVENT_COLUMNS = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def _whole(digits: str) -> int | float:
    """A whole number of a line; one with hundreds of digits is beyond every bound, so infinity stands for it."""
    return int(digits) if len(digits) < 400 else float(digits)


_EPOCH, _MS = datetime(1970, 1, 1), timedelta(milliseconds=1)


def _named(x) -> str | None:
    return x if isinstance(x, str) and x else None


def _object(x) -> dict | None:
    return x if isinstance(x, dict) else None


def _moment(x) -> int | None:
    """Milliseconds since the epoch of an ISO time."""
    if not isinstance(x, str):
        return None
    try:
        at = datetime.fromisoformat(x.strip())
    except ValueError:
        return None
    # On the clock of the text first: in UTC the moment may lie outside the years that a datetime has.
    return (at.replace(tzinfo=None) - _EPOCH - (at.utcoffset() or timedelta())) // _MS


def _iso(ms: int) -> str:
    """The moment in UTC; 400 years are a whole number of days, so years that a datetime lacks are shifted by them."""
    cycles = 0 if -62_135_596_800_000 <= ms < 253_402_300_800_000 else (1 if ms < 0 else -1)
    at = _EPOCH + timedelta(milliseconds=ms + cycles * 12_622_780_800_000)
    year = at.year - 400 * cycles
    shown = f"{year:04d}" if 0 <= year <= 9999 else f"{year:+07d}"
    return f"{shown}-{at.month:02d}-{at.day:02d}T{at.hour:02d}:{at.minute:02d}:{at.second:02d}.{ms % 1000:03d}Z"


def _identity(parts: list) -> str:
    return hashlib.sha256(json.dumps(parts, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()


def _distinct(flags) -> list[str]:
    return list(dict.fromkeys(flags))


@dataclass
class Reading:
    """Counters as a line reports them: values (None if unusable) and what is odd about them."""

    values: dict[str, int] | None
    flags: list[str]

    @classmethod
    def of(cls, raw) -> Reading:
        raw, flags, values = _object(raw), [], {}
        if raw is None:
            return cls(None, flags)
        for name in COUNTERS:
            x = raw.get(name)
            if x is None:
                if name in REQUIRED:
                    return cls(None, [*flags, "missing_required_counter"])
                values[name] = 0
                if name != "total_tokens":
                    flags.append(f"{name}_unreported")
            elif isinstance(x, bool) or not isinstance(x, int | float) or not float(x).is_integer() or not 0 <= x <= SAFE:
                return cls(None, [*flags, "invalid_counter"])
            else:
                values[name] = int(x)
        whole = values["input_tokens"] + values["output_tokens"]
        if whole > SAFE:
            return cls(None, [*flags, "counter_overflow"])
        if raw.get("total_tokens") is None:
            values["total_tokens"] = whole
            flags.append("total_tokens_derived")
        return cls(values, flags + cls.oddities(values, raw.get("total_tokens") is not None))

    @staticmethod
    def oddities(v: dict[str, int], with_total: bool = True) -> list[str]:
        checks = (
            ("total_tokens_mismatch", with_total and v["total_tokens"] != v["input_tokens"] + v["output_tokens"]),
            ("input_subsets_exceed_total", v["cached_input_tokens"] + v["cache_write_input_tokens"] > v["input_tokens"]),
            ("reasoning_exceeds_output", v["reasoning_output_tokens"] > v["output_tokens"]),
        )
        return [name for name, wrong in checks if wrong]

    @property
    def unreported(self) -> set[str]:
        return {f.removesuffix("_unreported") for f in self.flags if f.endswith("_unreported")}


@dataclass
class Rollout:
    """The state of one file; feed() takes its lines in order and gives (event or None, warnings, withheld)."""

    ordinal: int = 0
    session_id: str | None = None
    parent_session_id: str | None = None
    turn_id: str | None = None
    model: str = ""
    model_provider: str | None = None
    reasoning_effort: str | None = None
    service_tier: str | None = None
    project: str | None = None
    inherited_through: int = 0
    boundary_unknown: bool = False
    awaiting_context: bool = False
    totals: dict[str, int] | None = None
    totals_unreported: list[str] = field(default_factory=list)
    carried: list[str] = field(default_factory=list)
    seen_alone: list[str] = field(default_factory=list)
    pending: dict | None = None

    @classmethod
    def from_json(cls, text: str) -> Rollout:
        return cls(**json.loads(text))

    def to_json(self) -> str:
        return json.dumps(asdict(self), separators=(",", ":"))

    # --- one line ---

    def feed(self, line: str) -> tuple[dict | None, list[str], list[str]]:
        self.ordinal += 1
        self._warnings, self._withheld = [], []
        event = self._line(line) if line.strip() else None
        return event, _distinct(self._warnings), _distinct(self._withheld)

    def _hold(self, *codes: str) -> None:
        """Usage may be missing because of this line."""
        self._warnings += codes
        self._withheld += codes

    def _line(self, line: str) -> dict | None:
        try:
            doc = json.loads(line, parse_constant=_refuse, parse_int=_whole)
        except (ValueError, RecursionError):
            return self._hold("invalid_json")
        if _object(doc) is None:
            return self._hold("invalid_record")
        kind, payload = doc.get("type"), _object(doc.get("payload"))
        inherited = self.ordinal <= self.inherited_through
        if kind == "compacted" and self.pending and not inherited:
            return self._release("compaction_usage_from_record")
        if payload is None:
            return None
        if kind == "session_meta" and self.session_id is None:
            return self._own(doc, payload)
        if inherited:
            return None
        if kind == "session_meta":
            other = _named(payload.get("id")) or _named(payload.get("session_id"))
            if other and other != self.session_id:
                self._warnings.append("inherited_session_meta_ignored")
            return None
        message = payload.get("type") if kind == "event_msg" else None
        if message == "thread_settings_applied":
            settings = _object(payload.get("thread_settings"))
            if settings is not None and "service_tier" in settings:
                self.service_tier = _named(settings["service_tier"])
        if self.boundary_unknown:
            return self._before_boundary(kind, message)
        if kind == "turn_context":
            return self._turn(payload)
        if kind == "token_usage_record" and self._ours():
            return self._record(doc, payload)
        if message == "token_count" and _object(payload.get("info")) is not None and self._ours():
            return self._count(doc, payload["info"])
        return None

    def _ours(self) -> bool:
        """Whether usage on this line belongs to the file's own session."""
        if self.session_id is None:
            self._hold("usage_without_session")
        elif self.awaiting_context:
            self._hold("fork_usage_before_own_context")
        else:
            return True
        return False

    def _own(self, doc: dict, payload: dict) -> None:
        """The first header owns the file; a fork says where its own lines begin, or leaves it open."""
        name = _named(payload.get("id")) or _named(payload.get("session_id"))
        if name is None:
            return self._hold("missing_session_id")
        self.session_id, fork = name, _named(payload.get("forked_from_id"))
        self.parent_session_id = _named(payload.get("parent_thread_id")) or fork
        self.model_provider, self.project = _named(payload.get("model_provider")), _named(payload.get("cwd"))
        start = payload.get("subagent_history_start_ordinal")
        known = isinstance(start, int) and not isinstance(start, bool) and self.ordinal <= start <= SAFE
        self.inherited_through = start if known else 0
        self.boundary_unknown = fork is not None and not known
        self.awaiting_context = self.boundary_unknown or known
        if self.boundary_unknown:
            self._warnings.append("fork_history_boundary_unknown")
        return None

    def _before_boundary(self, kind, message) -> None:
        if message == "thread_settings_applied":
            self.boundary_unknown = False
            self.carried = _distinct([*self.carried, "fork_boundary_inferred"])
        elif message == "token_count" or kind == "token_usage_record":
            self._hold("fork_history_usage_withheld")

    def _turn(self, payload: dict) -> None:
        self.turn_id, self.model = _named(payload.get("turn_id")), _named(payload.get("model")) or ""
        self.reasoning_effort = _named(payload.get("effort")) or _named(payload.get("reasoning_effort"))
        if "service_tier" in payload:
            self.service_tier = _named(payload["service_tier"])
        self.project = _named(payload.get("cwd")) or self.project
        self.model_provider = _named(payload.get("model_provider")) or self.model_provider
        self.awaiting_context = False

    # --- events ---

    def _event(self, identity: list, usage: dict[str, int], flags: list[str], context: dict) -> dict:
        return {"event_id": ID_PREFIX + _identity(identity), "session_id": self.session_id, "parent_session_id": self.parent_session_id, **context, **usage, "flags": _distinct(flags)}

    def _context(self, ms: int, turn_id: str | None) -> dict:
        return {"us": ms * 1000, "turn_id": turn_id, **{c: getattr(self, c) for c in CONTEXT}}

    def _release(self, flag: str) -> dict:
        """The pending record as an event of its own: nothing else will report it."""
        held, self.pending = self.pending, None
        return self._event(["record", self.session_id, held["response_id"]], held["usage"], [*held["flags"], flag], held["context"])

    def _record(self, doc: dict, payload: dict) -> dict | None:
        """A usage record waits for the count that claims it."""
        thread = _named(payload.get("thread_id"))
        if thread and thread != self.session_id:
            self._warnings.append("usage_record_foreign_thread")
            return None
        response, ms, reading = _named(payload.get("response_id")), _moment(doc.get("timestamp")), Reading.of(payload.get("usage"))
        if response is None or ms is None or reading.values is None:
            self._warnings.append("usage_record_unusable")
            return None
        released = self._release("usage_record_without_token_count") if self.pending else None
        turn = _named(payload.get("turn_id")) or self.turn_id
        flags = reading.flags + ["model_unknown"] * (not self.model) + ["turn_id_unavailable"] * (not turn)
        self.pending = {"response_id": response, "usage": reading.values, "flags": flags, "context": self._context(ms, turn)}
        return released

    def _rebase(self, total: Reading, flags: list[str], *codes: str) -> None:
        """Take the totals as the new baseline without an event; flags go to the next one."""
        self._settle(total)
        self.carried = _distinct([*flags, *codes])

    def _settle(self, total: Reading) -> None:
        self.totals, self.totals_unreported = total.values, sorted(total.unreported)

    def _count(self, doc: dict, info: dict) -> dict | None:
        ms = _moment(doc.get("timestamp"))
        if ms is None:
            return self._hold("invalid_timestamp")
        total, last = Reading.of(info.get("total_token_usage")), Reading.of(info.get("last_token_usage"))
        self._warnings += total.flags + last.flags
        flags, repeats = list(self.carried), total.values is not None and total.values == self.totals
        if self.pending:
            if last.values != self.pending["usage"]:
                if repeats:  # nothing new in the count: the record is the only report of that request
                    return self._release("usage_record_without_token_count")
                self._hold("usage_record_unmatched")
                flags += ["usage_record_unmatched", "cumulative_gap"]
            self.pending = None
        if repeats:
            return None
        found = self._alone(ms, last, total, flags) if total.values is None else self._against_totals(total, last, flags)
        if found is None:
            return None
        identity, usage, flags = found
        carry = [f for f in _distinct(flags) if f not in OWN_FLAGS and not f.endswith("_unreported")]
        flags = flags + ["model_unknown"] * (not self.model) + ["turn_id_unavailable"] * (not self.turn_id) + [f for f in ("input_subsets_exceed_total", "reasoning_exceeds_output", "total_tokens_mismatch") if f in Reading.oddities(usage)]
        self._warnings += flags
        if not any(usage.values()):
            self.carried = carry
            return None
        self.carried = []
        return self._event(identity, usage, flags, self._context(ms, self.turn_id))

    def _alone(self, ms: int, last: Reading, total: Reading, flags: list[str]):
        """A count without totals: told apart from its repetitions by an id list."""
        if last.values is None:
            return self._hold("usage_counters_unavailable")
        identity = ["last", self.session_id, self.turn_id, _iso(ms), last.values["input_tokens"], last.values["output_tokens"]]
        name = _identity(identity)
        if name in self.seen_alone:
            return None
        self.seen_alone.append(name)
        self.totals = None  # totals that come later include this request
        return identity, last.values, [*flags, *last.flags, "last_usage_only", *total.flags]

    def _against_totals(self, total: Reading, last: Reading, flags: list[str]):
        new, old = total.values, self.totals
        blind = total.unreported | set(self.totals_unreported)
        exceeding = last.values is not None and any(last.values[c] > new[c] for c in COUNTERS if c not in last.unreported | total.unreported)
        if old is not None:
            if all(new[c] == old[c] for c in MAIN):
                self._warnings.append("counter_detail_revision_ignored")
                return self._rebase(total, flags, "counter_detail_revision_ignored")
            if any(new[c] < old[c] for c in COUNTERS if c not in blind):
                self._hold("counter_decreased")
                self.carried = _distinct([*flags, "counter_decreased"])  # the high-water mark stays
                return None
            flags = flags + total.flags + ["counter_detail_baseline_changed"] * bool(blind)
            problem = "last_usage_unavailable" if last.values is None else "last_exceeds_cumulative" if exceeding else None
            if problem:
                self._hold("cumulative_gap", problem)
                return self._rebase(total, flags, "cumulative_gap", problem)
            growth = {c: (last.values[c] if c not in last.unreported else 0) if c in blind else new[c] - old[c] for c in COUNTERS}
            if growth != last.values:
                flags = flags + ["last_usage_mismatch", "cumulative_gap"]
        else:
            flags = flags + total.flags
            problem = "cumulative_rebaseline_after_last_only" if self.seen_alone else "initial_cumulative_baseline_only" if last.values is None else "last_exceeds_cumulative" if exceeding else None
            if problem:
                self._hold(problem)
                return self._rebase(total, flags, "cumulative_gap", problem)
            flags = flags + last.flags
            if new != last.values:
                flags = flags + ["initial_cumulative_history_unattributed", "cumulative_gap"]
        self._settle(total)
        return ["cumulative", self.session_id, self.turn_id, new["input_tokens"], new["output_tokens"]], last.values, [*flags, *last.flags]


def _rows(path: str, lines, state: Rollout) -> list[tuple]:
    """Rows of EVENT_SCHEMA for each line that gives an event or a warning."""
    out = []
    for line in lines:
        event, warnings, withheld = state.feed(line or "")
        if event or warnings:
            row = {"path": path, "ordinal": state.ordinal, "warnings": warnings, "withheld": withheld} | (event or {})
            out.append(tuple(row.get(c) for c in EVENT_COLUMNS))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=EVENT_COLUMNS).astype({c: "Int64" for c in ("ordinal", "us", *COUNTERS)})


def parse_rollouts(lines: DataFrame) -> DataFrame:
    """lines(path, pos, value) as events and warnings (EVENT_SCHEMA; event_id is null for a warning alone).

    Lines stream through in order: a file of any length takes the memory of its state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, state = None, Rollout()
        for batch in batches:
            rows = []
            for name, part in batch.groupby("path", sort=False, dropna=False):
                if name != path:
                    path, state = name, Rollout()
                rows += _rows(path, part["value"].tolist(), state)
            yield _frame(rows)

    ordered = lines.select("path", "pos", "value").repartition("path").sortWithinPartitions("path", "pos").select("path", "value")
    return ordered.mapInPandas(run, EVENT_SCHEMA)


def rollout_events(parsed: DataFrame, since_us: int | None = None) -> DataFrame:
    """The events, from a moment on, with the flag that their account comes from configuration."""
    events = parsed.where("event_id IS NOT NULL")
    if since_us is not None:
        events = events.where(F.col("us") >= since_us)
    return events.withColumn("flags", F.array_union("flags", F.array(F.lit("configured_account_history"))))


def rollout_processor() -> Callable:
    """A stateful processor for streams grouped by path; pos orders the lines of a batch."""
    from pyspark.sql.streaming import StatefulProcessor

    class RolloutProcessor(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("rollout", "json string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            state = Rollout.from_json(self.state.get()[0]) if self.state.exists() else Rollout()
            lines = pd.concat(list(rows)).sort_values("pos", kind="stable")
            out = _rows(key[0], lines["value"].tolist(), state)
            self.state.update((state.to_json(),))
            yield _frame(out)

        def close(self) -> None:
            pass

    return RolloutProcessor()
