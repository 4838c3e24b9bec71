"""Line deduplication by two Bloom filters.

A line counts by its key: ASCII white space stripped at both ends, A-Z lower-cased. Keys of at least
`min_chars` code points that at least `min_docs` documents hold lose all their lines except in the document
with the largest doc_id.

1. Filters. Each task hashes the distinct long keys of its documents into partial filters: once-seen has the
   bits of every key, twice-seen those of keys that two of its documents hold. Only set bits travel, cut by
   range of the filter; the owner of a range carries them together: a bit that two partial once-seen filters
   share is twice-seen. Its twice-seen range goes to a file in the shared folder.
2. Suspects. Each document tests its keys against the twice-seen filter. A key that two documents hold is
   always found; others are found by chance once in some forty times. Lines that are not found end here, and
   neither they nor their hashes nor their doc_ids are ever shuffled.
3. Exact confirmation. Suspected keys are compared as text: distinct documents are counted and the one that
   keeps the line is chosen, by (key, salt) first and then by key, so a line that every document holds is spread
   over `SALTS` tasks and sums, never rows, meet in one.

The filters have one bit for some 4 to 8 bytes of text, and a long key takes more than `min_chars` of them, so
both the share of false suspects and the number of bits for each key are the same at every size. A range has at
most `MOST_RANGE` bits: with the text it is the number of ranges that grows, never what one task holds. A task reads
a range of the filter at a time (mapped, or in a cache of bounded size).

Defined results: null or empty text is one empty line; rows that share a doc_id are one document for counting
and get the same decisions; of equal largest doc_ids all rows keep their lines; a null doc_id is a document of
its own that sorts below every other; an empty table gives an empty result; other columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.llm.common import NO_ID, blob, cut, fresh, keyed, local_path, mix, owner_cuts, read_file, salt, seeded, shared_dir, unkeyed, write_file

MIN_CHARS, MIN_DOCS = 40, 5
_TRIM = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_U = np.uint64
PROBES = 2
_PROBE_SEEDS = seeded(31, PROBES)
#: Ranges that a filter is cut into as long as they are small, and the least and most bits of one.
RANGES, LEAST_RANGE, MOST_RANGE = 256, 1 << 16, 1 << 24
#: Hashes that a task holds before it hands on its partial filter.
HELD = 1 << 21
#: Bytes of filter that a task keeps in memory where files cannot be mapped.
CACHED = 64 << 20


def line_key(line: str) -> str:
    key = line.strip(_TRIM)
    return key.lower() if key.isascii() else key.translate(_LOWER)


def key_hash(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"))


def long_keys(text: str, min_chars: int) -> set[str]:
    """The distinct keys of at least min_chars code points; a key is never longer than its line."""
    return {k for k in {line_key(x) for x in text.split("\n") if len(x) >= min_chars} if len(k) >= min_chars}


class Layout:
    """Where the bits of a key are: `bits` in all (a power of two), in `ranges` ranges of 2**shift.

    Places are 64-bit numbers; inside a range they are below MOST_RANGE, so steps between them fit 32 bits.
    """

    def __init__(self, text_bytes: int):
        self.bits = max(LEAST_RANGE, 1 << (text_bytes // 8).bit_length())
        self.shift = min(MOST_RANGE, max(LEAST_RANGE, self.bits // RANGES)).bit_length() - 1
        self.ranges = self.bits >> self.shift

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """One row of bit positions for each probe."""
        return np.stack([(mix(hashes ^ s) & _U(self.bits - 1)).astype(np.int64) for s in _PROBE_SEEDS])


def _packed(positions: np.ndarray) -> bytes:
    """Sorted positions of a range as steps, with their first bytes together, then their second ones: that compresses well."""
    if len(positions) and positions[-1] >= 1 << 32:
        raise ValueError("a position inside a range has 32 bits")
    return blob(np.diff(positions, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _positions(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)


def _cut_ranges(positions: np.ndarray, shift: int) -> dict[int, bytes]:
    positions = np.unique(positions)
    owner = positions >> shift
    return {int(owner[a]): _packed(positions[a:b] & ((1 << shift) - 1)) for a, b in zip(*owner_cuts(owner), strict=True)}


def partial_filters(hashes: np.ndarray, layout: Layout) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, once-seen bits, twice-seen bits) of hashes, which a document gives once each."""
    distinct, count = np.unique(hashes, return_counts=True)
    once = _cut_ranges(layout.places(distinct).ravel(), layout.shift)
    twice = _cut_ranges(layout.places(distinct[count > 1]).ravel(), layout.shift)
    for at, bits in once.items():
        yield at, bits, twice.get(at, b"")


def carry(parts: Iterator[tuple[bytes, bytes]], shift: int) -> np.ndarray:
    """The twice-seen bits of one range from partial filters: shared once-seen bits are carried over."""
    once, twice = np.zeros(1 << shift, dtype=bool), np.zeros(1 << shift, dtype=bool)
    for seen, again in parts:
        at = _positions(seen)
        twice[at[once[at]]] = True
        once[at] = True
        twice[_positions(again)] = True
    return np.packbits(twice, bitorder="little")


class TwiceSeen:
    """The twice-seen filter in the shared folder, a range at a time."""

    def __init__(self, path: str, layout: Layout):
        self.path, self.layout, self.held, self.size = path, layout, {}, 0

    def _range(self, at: int) -> np.ndarray | None:
        if at not in self.held:
            name, local = range_path(self.path, at), local_path(self.path)
            try:
                data = np.memmap(local_path(name), dtype=np.uint8, mode="r") if local else np.frombuffer(read_file(name), dtype=np.uint8)
            except FileNotFoundError:  # no key has a bit there
                data = None
            if not local and data is not None:
                while self.held and self.size + len(data) > CACHED:
                    gone = self.held.pop(next(iter(self.held)))
                    self.size -= 0 if gone is None else len(gone)
                self.size += len(data)
            self.held[at] = data
        return self.held[at]

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for places in self.layout.places(hashes):
            order = np.argsort(places)
            places = places[order]
            for a, b in zip(*owner_cuts(places >> self.layout.shift), strict=True):
                bits = self._range(int(places[a] >> self.layout.shift))
                at = places[a:b] & ((1 << self.layout.shift) - 1)
                out[order[a:b]] &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1 if bits is not None else False
        return out


def range_path(path: str, at: int) -> str:
    return f"{path}/twice-{at:04d}.bits"


def _scan(min_chars: int, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[int] = []

        def hand_on() -> pa.RecordBatch:
            rows = list(partial_filters(np.array(hashes, dtype=_U), layout))
            hashes.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["at", "once", "twice"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                hashes += [key_hash(k) for k in long_keys(text, min_chars)]
                if len(hashes) >= HELD:
                    yield hand_on()
        yield hand_on()

    return run


def _carried(path: str, shift: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = key[0].as_py()
        bits = carry((pair for batch in batches for pair in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist(), strict=True)), shift)
        write_file(range_path(path, at), bits.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([int(np.bitwise_count(bits).sum())], pa.int64())], names=["at", "n_bits"])

    return run


_SUSPECTS = "doc_id long, n_lines long, digest string, key string"


def _suspects(min_chars: int, path: str, layout: Layout):
    """For each document its number of lines and digest, and a row for each suspected key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TwiceSeen(path, layout)
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                keys, rows, lines, digests = [], [], [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    lines.append(text.count("\n") + 1)
                    digests.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                    found = long_keys(text, min_chars)
                    keys += found
                    rows += [row] * len(found)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(digests, pa.string()), pa.nulls(n, pa.string())], names=["doc_id", "n_lines", "digest", "key"])
                again = np.flatnonzero(seen.repeated(np.array([key_hash(k) for k in keys], dtype=_U)))
                ids = batch.column(0).to_numpy(zero_copy_only=False)[np.array(rows, dtype=np.int64)[again]]
                m = len(again)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.array([keys[i] for i in again.tolist()], pa.string())], names=["doc_id", "n_lines", "digest", "key"])

    return run


def _rewrite(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, dropped, digests = [], [], [], []
            for doc_id, text, keys in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                drop, lines = set(keys), text.split("\n")
                stay = [x for x in lines if len(x) < min_chars or line_key(x) not in drop]
                kept = "\n".join(stay)
                ids.append(doc_id)
                sizes.append(len(lines))
                dropped.append(len(lines) - len(stay))
                digests.append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return run


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_lines, digest) of each row of docs, and (doc_id, keys) of the lines that a document loses."""
    texts = keyed(docs)
    layout = Layout(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    path = shared_dir(docs.sparkSession, "line-filter")
    partial = texts.select("text").mapInArrow(_scan(min_chars, layout), "at int, once binary, twice binary")
    cut(partial.groupBy("at").applyInArrow(_carried(path, layout.shift), "at int, n_bits long"), "line-ranges")

    scanned = cut(texts.mapInArrow(_suspects(min_chars, path, layout), _SUSPECTS), "suspected-lines")
    suspects = scanned.where("key IS NOT NULL").select("key", salt().alias("salt"), "doc_id")
    lines = cut(suspects.repartition("key", "salt").dropDuplicates(["key", "salt", "doc_id"]), "line-documents")
    parts = cut(lines.groupBy("key", "salt").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")), "line-parts")
    repeats = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max("last").alias("keep_id")).where(F.col("n") >= min_docs).select("key", "keep_id")
    told = parts.select("key", "salt").join(repeats, "key")
    losing = lines.join(told, ["key", "salt"]).where("doc_id <> keep_id").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    return scanned.where("n_lines IS NOT NULL").select("doc_id", "n_lines", "digest"), cut(losing, "lost-lines")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: one row for each row of docs."""
    sizes, losing = repeated_lines(docs, min_chars, min_docs)
    rewritten = keyed(docs).join(losing, "doc_id").mapInArrow(_rewrite(min_chars), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    whole = sizes.join(losing.select("doc_id"), "doc_id", "left_anti").select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("digest").alias("kept_sha256"))
    return unkeyed(whole.unionByName(rewritten))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the repeated lines gone from text and n_chars following it; all columns stay."""
    _, losing = repeated_lines(docs, min_chars, min_docs)
    key, lost = fresh(docs, "_key"), fresh(docs, "_lost")
    marked = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).join(losing.select(F.col("doc_id").alias(key), F.col("keys").alias(lost)), key, "left")
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(_kept_text(min_chars)(F.col("text"), F.col(lost)))
    out = marked.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def _kept_text(min_chars: int):
    @F.pandas_udf("string")
    def kept(text: pd.Series, lost: pd.Series) -> pd.Series:
        out = []
        for t, keys in zip(text, lost, strict=True):
            if keys is None or t is None:
                out.append(t)
                continue
            drop = set(keys)
            out.append("\n".join([x for x in t.split("\n") if len(x) < min_chars or line_key(x) not in drop]))
        return pd.Series(out, dtype=object)

    return kept
