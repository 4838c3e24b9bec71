"""Helpers that the corpus operators share: shared-folder tables and vectorised word hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators and comes out as null again; the smallest long is no doc_id of its own.
NO_ID = -(2**63)
#: Parts that the rows of one key are split into where many rows may share it.
SALTS = 64
#: Bytes of text that the numpy kernels work on at a time.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a local session takes a folder of its own; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), f"checkpoints-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salt(doc_id="doc_id"):
    """Which part of its key's rows a document belongs to."""
    return F.pmod(F.xxhash64(doc_id, F.lit("salt")), F.lit(SALTS)).cast("int")


def local_path(path: str) -> str | None:
    """The path as the operating system knows it, None for a path that only a file system of its own reads."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def write_file(path: str, data: bytes) -> None:
    """Write a shared file; it appears complete or not at all."""
    local = local_path(path)
    temporary = f"{local or path}.{os.getpid()}.{os.urandom(4).hex()}.part"
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(temporary, "wb") as f:
            f.write(data)
        os.replace(temporary, local)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(temporary)
    with store.open_output_stream(at) as f:
        f.write(data)
    store.move(at, fs.FileSystem.from_uri(path)[1])


def read_file(path: str) -> bytes:
    local = local_path(path)
    if local:
        with open(local, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        return f.read()


#: Drops the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that lineage ends there.

    Nothing reads the shuffle files of that write afterwards, so they go at once instead of with the garbage.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*written: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id (null as NO_ID) and the text column (null as empty), nothing else."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"),
    )


def unkeyed(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))


def lower_ascii(column):
    """Lower-case A-Z and leave every other letter as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- vectorised hashing -------------------------------------------------------------------------

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def seeded(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 20)) * _U(0x9E3779B97F4A7C15))


_BYTE = seeded(1, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, dtype=_U)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each pair: a polynomial modulo 2**64 over random symbols, mixed."""
    n = len(values)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=_U)
        np.cumsum(values * powers(base, n), out=total[1:])
        return mix((total[ends] - total[starts]) * powers(_inverse(base), n + 1)[starts])


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive rows; a row longer than limit comes alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    if len(column) == 0:
        return
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if big else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than [\\x20\\x09-\\x0D]) and each row's first word."""
    solid = ~_SPACE[data]
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    full = offs[1:] > offs[:-1]
    before[offs[:-1][full]] = False
    after[offs[1:][full] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word and each row's first word."""
    starts, ends, at = words_of(data, offs)
    return ranges_hash(_BYTE[_LOWER[data] if lower else data], starts, ends, _BASE), at


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive word hashes, without regard to rows."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    with np.errstate(over="ignore"):
        values = mix(words ^ _U(seed * 0xA24BAED4963EE407 & (2**64 - 1))) if seed else words
        if k <= 3:
            out = values[:n].copy()
            for i in range(1, k):
                out = out * _U(_WORD_BASE) + values[i : i + n]
            return mix(out)
    at = np.arange(n)
    return ranges_hash(values, at, at + k, _WORD_BASE + 2 * seed)


def sliding(values: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    """op over each run of width values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    done = 1
    while 2 * done <= width:
        values = op(values[:-done], values[done:])
        done *= 2
    return op(values[:n], values[width - done : width - done + n]) if done < width else values[:n]


def row_of(at: np.ndarray) -> np.ndarray:
    """The row of each word, from each row's first word."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


# --- packed exchange --------------------------------------------------------------------------------


def owner_cuts(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a sorted array."""
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return cuts, np.append(cuts[1:], len(owner))


def deal_by_document(values: np.ndarray, docs: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, docs, values): values packed by the part that gathers a document, a row for each part."""
    owner = ((mix(docs.view(_U)) >> _U(20)) % _U(parts)).astype(np.int32)
    order = np.lexsort((docs, owner))
    values, docs, owner = values[order], docs[order], owner[order]
    cuts, ends = owner_cuts(owner)
    packed = [pa.array([blob(x[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary()) for x in (docs, values)]
    return pa.RecordBatch.from_arrays([pa.array(owner[cuts], pa.int32()), *packed], names=["part", "docs", "values"])


def gather_documents(dealt: DataFrame, kind: np.dtype, parts: int) -> DataFrame:
    """(doc_id, values): one row for each document of frames of deal_by_document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, docs = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
        for batch in batches:
            values += [np.frombuffer(x, dtype=kind) for x in batch.column("values").to_pylist()]
            docs += [np.frombuffer(x, dtype=np.int64) for x in batch.column("docs").to_pylist()]
        v, d = np.concatenate(values), np.concatenate(docs)
        order = np.argsort(d, kind="stable")
        v, d = v[order], d[order]
        cuts, ends = owner_cuts(d)
        for i in range(0, len(cuts), 2048):
            a, b = cuts[i : i + 2048], ends[i : i + 2048]
            yield pa.RecordBatch.from_arrays([pa.array(d[a], pa.int64()), pa.array([blob(v[x:y]) for x, y in zip(a, b, strict=True)], pa.binary())], names=["doc_id", "values"])

    return dealt.repartition(parts, "part").select("docs", "values").mapInArrow(run, "doc_id long, values binary")
