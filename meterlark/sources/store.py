"""A log-structured store of records in plain Parquet: appended epochs, merged runs, and a manifest that says what counts.

Every batch appends one part, named by its epoch. Parts are merged into runs of ever more epochs, and a reader merges
what the newest manifest lists, so it sees the same rows before and after a merge, or when one dies half way: a part
that no manifest lists is not there. A manifest is a numbered JSON file that is created once and never changed; one that
was not finished cannot be read and does not count. An epoch that is listed already is not appended again, which makes
a batch that runs twice harmless.

What a merge keeps is up to the store's Merge: it gets rows and gives rows of the same columns, and must not mind how
rows are split into parts. `RECORDS` keeps one row for each usage record; `SUMS` adds up contributions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.functions.scalars import semantic_id, usage_rank
from meterlark.operators.dedup import USAGE_COLUMNS, first_inserts

#: Parts of a level that are merged into one of the next.
FAN = 8
#: Where a row came from: its epoch and its place in it, and the same of what it was last updated by.
ORIGIN = ("arrival", "seq", "u_arrival", "u_seq", "copies")


@dataclass(frozen=True)
class Part:
    path: str
    level: int
    first: int
    last: int


def merge_records(rows: DataFrame, whole: bool) -> DataFrame:
    """One row for each (message_id, request_id): identity of the first arrival, usage of the highest rank, first on a tie.

    Rows without a request id are never replaced; they are told apart by message and by content, which is decided in
    order of arrival and so only when every row before is at hand (`whole`). Until then those with both equal fold.
    """
    order, updated = F.struct("arrival", "seq"), F.struct(-F.col("u_arrival"), -F.col("u_seq"))
    usage = (*USAGE_COLUMNS, "u_arrival", "u_seq")
    identity = [c for c in rows.columns if c not in usage and c not in ("copies", "message_id", "request_id")]
    blank = F.col("request_id") == ""
    keyed = rows.withColumn("_content", F.when(blank, F.coalesce("semantic_id", semantic_id())))
    rank = F.when(blank, F.lit(0)).otherwise(usage_rank())
    merged = keyed.groupBy("message_id", "request_id", "_content").agg(
        F.min_by(F.struct(*identity), order).alias("_i"),
        F.when(F.first("request_id") == "", F.min_by(F.struct(*usage), order)).otherwise(F.max_by(F.struct(*usage), F.struct(rank.alias("r"), updated.alias("o")))).alias("_u"),
        F.sum("copies").alias("copies"),
    ).select("message_id", "request_id", "_content", "_i.*", "_u.*", "copies")
    if whole:
        merged = merged.where(~blank).unionByName(first_inserts(merged.where(blank), ["message_id", "_content"], ["arrival", "seq"]))
    return merged.select(*rows.columns)


def merge_sums(keys: list[str], sums: list[str]) -> Callable[[DataFrame, bool], DataFrame]:
    """Rows of equal keys added up; what adds up to nothing goes when all of it is at hand."""

    def merge(rows: DataFrame, whole: bool) -> DataFrame:
        added = rows.groupBy(*keys).agg(*[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in sums])
        some = F.lit(False)
        for c in sums:
            some = some | (F.col(c) != 0)
        return (added.where(some) if whole else added).select(*rows.columns)

    return merge


class Store:
    """Records under a path that any Hadoop file system can reach."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame, bool], DataFrame] = merge_records):
        self.spark, self.path, self.merge = spark, path.rstrip("/"), merge
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- manifest ---

    def _listed(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _manifest(self, name: str) -> list[Part] | None:
        stream = self._fs.open(self._at(f"{self.path}/manifest/{name}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            read = json.loads(text)
        except ValueError:  # its writer died
            return None
        return [Part(**p) for p in read["parts"]] if read.get("complete") else None

    def version(self) -> tuple[int, list[Part]]:
        """The number of the newest manifest that is complete, and its parts by epoch."""
        for name in reversed(self._listed("manifest")):
            parts = self._manifest(name)
            if parts is not None:
                return int(name.split(".")[0]), sorted(parts, key=lambda p: p.first)
        return 0, []

    def _commit(self, base: int, parts: list[Part]) -> None:
        """Publish parts as the manifest after `base`; fails if another writer has published since."""
        names = self._listed("manifest")
        newest = int(names[-1].split(".")[0]) if names else 0
        if any(self._manifest(n) is not None for n in names if int(n.split(".")[0]) > base):
            raise RuntimeError(f"{self.path} was changed by another writer")
        body = json.dumps({"parts": [vars(p) for p in parts], "complete": True}).encode()
        stream = self._fs.create(self._at(f"{self.path}/manifest/{newest + 1:010d}.json"), False)
        try:
            stream.write(bytearray(body))
        finally:
            stream.close()

    # --- writing ---

    def _put(self, rows: DataFrame, level: int, first: int, last: int) -> Part:
        part = Part(f"data/level={level}-{first:010d}-{last:010d}-{uuid.uuid4().hex}", level, first, last)
        rows.write.parquet(f"{self.path}/{part.path}")
        return part

    def epochs(self) -> set[int]:
        return {e for p in self.version()[1] for e in range(p.first, p.last + 1)}

    def append(self, rows: DataFrame, epoch: int) -> bool:
        """Add the rows of an epoch; False if it is in the store already. Epochs come in ascending order."""
        base, parts = self.version()
        if parts and epoch <= parts[-1].last:
            return False
        first = parts[-1].last + 1 if parts else epoch
        self._commit(base, [*parts, self._put(rows, 0, min(first, epoch), epoch)])
        return True

    def append_records(self, rows: DataFrame, epoch: int) -> bool:
        """Add usage records in the order that they have in rows: their place in the epoch is part of the row."""
        seq = F.monotonically_increasing_id()
        numbered = rows.withColumns({"arrival": F.lit(epoch).cast("long"), "seq": seq})
        return self.append(numbered.withColumns({"u_arrival": F.col("arrival"), "u_seq": F.col("seq"), "copies": F.lit(1).cast("long")}), epoch)

    # --- reading and merging ---

    def _rows(self, parts: list[Part]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/{p.path}" for p in parts]) if parts else None

    def read(self) -> DataFrame | None:
        """The rows of the store, merged; None where nothing was ever appended."""
        rows = self._rows(self.version()[1])
        return None if rows is None else self.merge(rows, True)

    def _replace(self, run: list[Part], level: int) -> None:
        base, parts = self.version()
        whole = parts[0] == run[0]
        merged = self._put(self.merge(self._rows(run), whole), level, run[0].first, run[-1].last)
        self._commit(base, [p for p in parts if p not in run] + [merged])

    def compact(self, fan: int = FAN) -> int:
        """Merge runs of `fan` neighbouring parts of a level until none is left; how many merges that were.

        A row is rewritten once for each level, a number that grows with the logarithm of the epochs.
        """
        merges = 0
        while True:
            _, parts = self.version()
            runs = [parts[i : i + fan] for i in range(len(parts) - fan + 1)]
            ripe = [r for r in runs if len({p.level for p in r}) == 1]
            if not ripe:
                return merges
            run = min(ripe, key=lambda r: (r[0].level, r[0].first))
            self._replace(run, run[0].level + 1)
            merges += 1

    def compact_all(self) -> None:
        """Everything as one part."""
        _, parts = self.version()
        if len(parts) > 1:
            self._replace(parts, max(p.level for p in parts) + 1)

    def vacuum(self) -> int:
        """Delete parts that the newest manifest does not list, and older manifests; how many parts went.

        Run it when no reader or writer is left that began before the newest manifest.
        """
        number, parts = self.version()
        live = {p.path.split("/")[1] for p in parts}
        gone = [name for name in self._listed("data") if name not in live]
        for name in gone:
            self._fs.delete(self._at(f"{self.path}/data/{name}"), True)
        for name in self._listed("manifest"):
            if int(name.split(".")[0]) < number:
                self._fs.delete(self._at(f"{self.path}/manifest/{name}"), False)
        return len(gone)


def stored_records(store: Store) -> DataFrame:
    """The records of a store without what it keeps about their origin."""
    return store.read().drop(*ORIGIN)
