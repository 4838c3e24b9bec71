"""Deduplication by completeness rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.functions.scalars import dedup_key, usage_rank
from meterlark.sources.shared import written

USAGE_COLUMNS = ("input_tokens", "output_tokens", "thinking_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens", "output_final")


def dedup_batch(feed: DataFrame, order: str = "arrival") -> DataFrame:
    """One whole row for each key: the highest rank, the first arrival on a tie. One shuffle, folded map-side."""
    row = F.struct(*feed.columns)
    best = feed.groupBy(dedup_key().alias("dedup_key")).agg(F.max_by(row, F.struct(usage_rank(), -F.col(order), -F.col("event_id"))).alias("row"))
    return best.select("dedup_key", "row.*")


def dedup_upsert(feed: DataFrame, order: str = "arrival") -> DataFrame:
    """Identity columns of the first arrival with the usage columns of the highest rank (first arrival on a tie).

    Rows without a request id never replace what is there, and one is refused that has the message or the content of
    an earlier one: of those only first arrivals stay, whole.
    """
    identity = [c for c in feed.columns if c not in USAGE_COLUMNS]
    blank = F.col("request_id") == ""
    merged = feed.groupBy(dedup_key().alias("dedup_key"), F.when(blank, F.col("message_id")).alias("_message")).agg(
        F.min_by(F.struct(*identity), F.struct(order, "event_id")).alias("i"),
        F.max_by(F.struct(*USAGE_COLUMNS), F.struct(F.when(blank, F.lit(0)).otherwise(usage_rank()), -F.col(order), -F.col("event_id"))).alias("u"),
        F.count("*").alias("copies"),
    )
    flat = merged.select("dedup_key", "_message", "i.*", "u.*", "copies")
    alone = F.col("_message").isNull()
    rivals = first_inserts(flat.where(~alone), ["_message", "dedup_key"], [order, "event_id"])
    return flat.where(alone).unionByName(rivals).drop("_message")


def first_inserts(rows: DataFrame, unique: list[str], order: list[str]) -> DataFrame:
    """Rows as they enter a table one by one in order, where a row that equals an earlier one in any column of `unique` is refused.

    A refused row refuses nobody, so this is decided in rounds: a row that is first among those undecided by every
    column stays, what shares a value with it goes. Rows without a rival are decided in the first round; each round is
    written, and most inputs need one or two.
    """
    kept, left = None, rows
    place = F.struct(*order)
    while True:
        marked = left.withColumn("_o", place)
        for i, c in enumerate(unique):
            firsts = left.groupBy(c).agg(F.min(place).alias(f"_f{i}"), F.count("*").alias(f"_n{i}"))
            marked = marked.join(firsts, c)
        first = F.lit(True)
        for i in range(len(unique)):
            first = first & (F.col("_o") == F.col(f"_f{i}"))
        marked = written(marked.withColumn("_first", first).select(*rows.columns, "_first"), "insert-round")
        stay = marked.where("_first").drop("_first")
        kept = stay if kept is None else kept.unionByName(stay)
        left = marked.where("NOT _first").drop("_first")
        for c in unique:
            left = left.join(stay.select(c), c, "left_anti")
        left = left.select(*rows.columns)
        if left.isEmpty():
            return kept.select(*rows.columns)


def insert_once(feed: DataFrame, keys: list[str], order: str, body: str) -> tuple[DataFrame, DataFrame]:
    """(first arrival of each key, evidence of later arrivals whose body differs)."""
    first = feed.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in feed.columns if c not in keys]), F.col(order)).alias("r")).select(*keys, "r.*")
    recorded = first.select(*keys, F.sha2(F.col(body), 256).alias("recorded"))
    conflicts = feed.withColumn("hash", F.sha2(F.col(body), 256)).join(recorded, keys).where("hash <> recorded").select(*keys, "hash", "recorded").distinct()
    return first, conflicts


def latest_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest order value of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def with_latest(left: DataFrame, rows: DataFrame, keys: list[str], order: str, columns: list[str], ties: Sequence[str] = ()) -> DataFrame:
    """left with columns of the latest of its rows (of equal moments the largest ties), null where it has none."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(order, *ties)).alias("_l"))
    return left.join(last, keys, "left").select(*left.columns, *[F.col("_l")[c].alias(c) for c in columns])


def append_new(stored: DataFrame, incoming: DataFrame, keys: list[str], order: Sequence[str] = ()) -> DataFrame:
    """stored and those incoming rows whose key is new: each key once, a stored row before an incoming one, then the first in order, then the smallest."""
    rest = [*order, *[c for c in stored.columns if c not in keys and c not in order]]
    both = stored.withColumn("_new", F.lit(1)).unionByName(incoming.withColumn("_new", F.lit(2)))
    first = both.groupBy(*keys).agg(F.min(F.struct("_new", *rest)).alias("_r"))
    return first.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in stored.columns])
