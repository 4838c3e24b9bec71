"""Scalar expressions of the usage domain; every function gives a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PARTS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens")


def quota_tokens() -> Column:
    """All tokens of a request; thinking is part of the output already."""
    out = F.col(TOKEN_PARTS[0])
    for part in TOKEN_PARTS[1:]:
        out = out + F.col(part)
    return out


def counts_toward_quota(model: str = "model") -> Column:
    name = F.lower(F.trim(F.col(model)))
    return name.rlike(r"^(claude|(opus|sonnet|haiku|fable)([-.]|$))")


def normalized_model(model: str = "model") -> Column:
    """The name without a bracketed suffix."""
    return F.trim(F.regexp_replace(F.col(model), r"\[[^\]]*\]$", ""))


def semantic_id() -> Column:
    """Identity of a request without a request id: what it was, to the millisecond."""
    return F.substring(F.sha2(F.concat_ws("|", "session_id", F.floor(F.col("us") / 1000), "model", *(F.col(p) for p in TOKEN_PARTS)), 256), 1, 32)


def dedup_key() -> Column:
    both = (F.col("message_id") != "") & (F.col("request_id") != "")
    return F.when(both, F.concat_ws("|", "message_id", "request_id")).otherwise(F.concat_ws("|", F.lit("sem"), semantic_id()))


def usage_rank() -> Column:
    """How complete a record is: more output first, then a known final state."""
    return F.col("output_tokens") * 3 + F.when(F.col("output_final"), 2).when(~F.col("output_final"), 1).otherwise(0)


def window_us(kind: str = "window_kind") -> Column:
    """Length of a window by its name: anything weekly first, five hours otherwise."""
    weekly = F.lower(F.col(kind)).rlike("seven|7d|week")
    return F.when(weekly, F.lit(604_800_000_000)).otherwise(F.lit(18_000_000_000))


def window_label(kind: str = "window_kind") -> Column:
    c, rest = F.col(kind), F.regexp_extract(F.col(kind), "^seven_day_(.+)$", 1)
    return F.when(c == "five_hour", "5h").when(c == "seven_day", "7d").when(rest != "", F.concat(F.lit("7d "), F.upper(F.substring(rest, 1, 1)), F.substring(rest, 2, 1000))).otherwise(c)


def waste_pct(pct: Column) -> Column:
    return clamp_pct(100 - pct)


def clamp_pct(pct: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), pct))


def half_up(x: Column) -> Column:
    """Round half up towards +infinity, as the reports do."""
    return F.floor(x + 0.5)


def cache_hit_pct(read: Column, all_input: Column) -> Column:
    return F.try_divide(read * 100.0, all_input)


def ring_tone(used: Column, projected: Column) -> Column:
    return F.when(used >= 90, "danger").when((used >= 70) | (projected >= 95), "warn").otherwise("ok")


def nice_max_pct(peak: Column) -> Column:
    out = F.when(peak * 1.15 <= 10, 10)
    for top in (25, 50, 75, 100):
        out = out.when(peak * 1.15 <= top, top)
    return out.otherwise(110)


def duration_label(minutes: Column) -> Column:
    whole = minutes.cast("long")
    return (
        F.when(whole % 1440 == 0, F.concat((whole / 1440).cast("long").cast("string"), F.lit("d")))
        .when(whole % 60 == 0, F.concat((whole / 60).cast("long").cast("string"), F.lit("h")))
        .otherwise(F.concat(whole.cast("string"), F.lit("m")))
    )


def in_family(model: Column, family: Column) -> Column:
    """Whether a model name, after its vendor prefix, belongs to a family."""
    return F.regexp_replace(F.lower(model), r"^claude[-.]", "").startswith(family)
