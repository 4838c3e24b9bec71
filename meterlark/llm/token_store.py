"""Token ids in binary shards with a minimal perfect hash index.

Layout of a store (a folder that driver and executors share):

* `shard-PPPPPP-SSSS.ids`: raw token ids, little-endian, 16 bits each if the vocabulary allows it, otherwise
  32; documents follow one another in ascending doc_id order, each closed by the end id. No framing.
* `index-BBBBBB.mph`: for each bucket of keys a minimal perfect hash function (a cascade of bit arrays with
  rank directories), and for each slot a stored 32-bit fingerprint, the shard, the offset and the length.

A lookup hashes the key, reads one bit in one or few levels, takes the rank as slot and compares the
fingerprint: constant time whatever the number of keys. Keys are (doc_id, occurrence), so rows that repeat
a doc_id are separate documents, adjacent in the shard. A null doc_id sorts first and keeps its key. Null
text counts as empty: such a document has the end id alone. An empty table gives a store without shards.

Files are written under their final name only when complete, so a task that runs again after an executor
is lost writes the same file once more.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlark.llm.common import cut, keyed, mix, partitions, read_file, shared_dir, text_chunks, unkeyed, write_file

SHARD_IDS = 1 << 24
#: Keys that one index file holds, about.
INDEX_KEYS = 1 << 20
#: Pieces of text whose ids a Python worker remembers, in each of two generations (some 50 MB each); a chunk adds as many again at most.
REMEMBERED = 250_000
_U = np.uint64


# --- minimal perfect hashing ------------------------------------------------------------------------


def key_hash(doc_id: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(doc_id.astype(np.int64).view(_U) ^ mix(occurrence.astype(_U) + _U(0x51ED270B)))


class PerfectHash:
    """Levels of bit arrays: a key lives in the first level where it has a bit of its own; its slot is the rank of that bit."""

    LEVELS, ROOM = 40, 2.0

    def __init__(self, bits: list[np.ndarray], sizes: list[int], rest: np.ndarray):
        self.bits, self.sizes, self.rest = bits, sizes, rest
        self.ranks, total = [], 0
        for words in bits:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(total + np.concatenate(([0], np.cumsum(counts)[:-1])))
            total += int(counts.sum())
        self.placed = total

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return mix(keys ^ mix(np.full(1, level + 1, dtype=_U))[0]) % _U(size)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, sizes = [], []
        while len(keys) and len(bits) < cls.LEVELS:
            size = max(64, -(-int(len(keys) * cls.ROOM) // 64) * 64)
            at = cls._place(keys, len(bits), size).astype(np.int64)
            once = np.bincount(at, minlength=size) == 1
            words = np.packbits(once, bitorder="little").view(_U)
            bits.append(words)
            sizes.append(size)
            keys = keys[~once[at]]
        return cls(bits, sizes, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot or -1 for keys that the function was not built for."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, (words, size, ranks) in enumerate(zip(self.bits, self.sizes, self.ranks, strict=True)):
            if not len(todo):
                return out
            at = self._place(keys[todo], level, size)
            word, bit = (at >> _U(6)).astype(np.int64), at & _U(63)
            hit = (words[word] >> bit) & _U(1) == 1
            below = words[word[hit]] & ((_U(1) << bit[hit]) - _U(1))
            out[todo[hit]] = ranks[word[hit]] + np.bitwise_count(below)
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            found = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            same = self.rest[found] == keys[todo]
            out[todo[same]] = self.placed + found[same]
        return out


class Index:
    """A perfect hash with fingerprints and (shard, offset, length) for each slot, as one file."""

    COLUMNS = ("fingerprint", "shard", "offset", "length")

    def __init__(self, function: PerfectHash, columns: dict[str, np.ndarray]):
        self.function, self.columns = function, columns

    @classmethod
    def build(cls, keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, length: np.ndarray) -> Index:
        function = PerfectHash.build(keys)
        slots = function.slots(keys)
        columns = {}
        for name, values in (("fingerprint", (mix(keys) >> _U(32)).astype(np.uint32)), ("shard", shard.astype(np.uint64)), ("offset", offset.astype(np.uint64)), ("length", length.astype(np.uint32))):
            columns[name] = np.zeros(len(keys), dtype=values.dtype)
            columns[name][slots] = values
        return cls(function, columns)

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(found, shard, offset, length) of each key; a strange key is found once in 2**32 times."""
        n = len(self.columns["fingerprint"])
        slots = self.function.slots(keys) if n else np.full(len(keys), -1)
        at = np.clip(slots, 0, max(n - 1, 0))
        if not n:
            none = np.zeros(len(keys), dtype=np.int64)
            return none.astype(bool), none, none, none
        found = (slots >= 0) & (self.columns["fingerprint"][at] == (mix(keys) >> _U(32)).astype(np.uint32))
        return found, self.columns["shard"][at], self.columns["offset"][at], self.columns["length"][at]

    def to_bytes(self) -> bytes:
        arrays = [*self.function.bits, self.function.rest, *(self.columns[c] for c in self.COLUMNS)]
        head = json.dumps({"levels": self.function.sizes, "arrays": [[a.dtype.str, len(a)] for a in arrays]}).encode()
        head += b" " * (-(len(head) + 8) % 8)
        return b"".join([b"MPH1", len(head).to_bytes(4, "little"), head, *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)])

    @classmethod
    def from_bytes(cls, data: bytes) -> Index:
        if data[:4] != b"MPH1":
            raise ValueError("not an index file")
        end = 8 + int.from_bytes(data[4:8], "little")
        head, arrays = json.loads(data[8:end]), []
        for kind, n in head["arrays"]:
            arrays.append(np.frombuffer(data, dtype=kind, count=n, offset=end))
            end += -(-arrays[-1].nbytes // 8) * 8
        levels = len(head["levels"])
        function = PerfectHash(arrays[:levels], head["levels"], arrays[levels])
        return cls(function, dict(zip(cls.COLUMNS, arrays[levels + 1 :], strict=True)))


# --- encoding ----------------------------------------------------------------------------------------


#: New pieces that the library encodes as one text.
RUN = 512
#: Code points of a piece that is remembered, at most.
PIECE = 64
#: Bytes of text that are cut into pieces at a time; a longer text comes alone.
CHUNK = 1 << 22

_WHITE, _BREAK, _SYMBOL, _LETTER, _LEAD = 1, 2, 4, 8, 16
#: What a byte may be: white space, a space or line feed, a symbol, a letter, the first byte of wider white space.
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[*range(9, 14), *range(28, 33)]] |= _WHITE
_KINDS[[10, 32]] |= _BREAK
_KINDS[np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] |= _SYMBOL
_KINDS[[*range(65, 91), *range(97, 123)]] |= _LETTER
_KINDS[[0xC2, 0xE1, 0xE2, 0xE3]] |= _LEAD
_WIDE = {n: np.array([int.from_bytes(c.encode(), "big") for c in map(chr, (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) if len(c.encode()) == n]) for n in (2, 3)}


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8; all bytes of wider white space count as white space."""
    kinds = _KINDS[data]
    lead = np.flatnonzero(kinds & _LEAD)
    if len(lead):
        code = data[lead].astype(np.int64)
        for n in (2, 3):
            lead, code = lead[lead < len(data) - n + 1], code[: np.searchsorted(lead, len(data) - n + 1)]
            code = code << 8 | data[lead + n - 1]
            at = lead[np.isin(code, _WIDE[n])]
            for i in range(n):
                kinds[at + i] |= _WHITE
    return kinds


class Encoder:
    """Token ids of whole texts by the tokenizers library, with the ids of pieces remembered.

    The byte-level pattern always cuts before a space or line feed that has no white space beside it, after
    such a line feed, and between a letter and a symbol, and what it finds on one side does not depend on the
    other. Texts are cut there, a chunk of them at once, and the library encodes each distinct piece. Texts with
    strings of special tokens go to it whole. Pieces of up to PIECE code points are remembered in two
    generations: when the newer one is full it becomes the older, from which pieces that occur again come back.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and not any(c.isspace() for s in self.special for c in s)
        #: Tokens that begin with a space or line feed.
        self.opening = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.opening[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.startswith(("\u0120", "\u010a"))]] = True
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space other than a space or line feed in front, by the library in runs of them.

        A piece with nothing in front gets a line feed, a token of its own. So each piece is the only one of its
        bytes that begins with a space or line feed, and the tokens that do tell where each starts.
        """
        out: list[bytes] = []
        width = self.kind.itemsize
        for i in range(0, len(pieces), RUN):
            some = pieces[i : i + RUN]
            bare = [p[0] not in " \n" for p in some]
            ids = np.frombuffer(self._library(["".join(["\n" + p if b else p for p, b in zip(some, bare, strict=True)])])[0], dtype=self.kind)
            at = np.flatnonzero(self.opening[ids])
            if len(at) != len(some) or at[0] != 0:  # no byte-level vocabulary after all
                out += self._library(some)
                continue
            data, ends = ids.tobytes(), (np.append(at[1:], len(ids)) * width).tolist()
            out += [data[a:b] for a, b in zip(((at + bare) * width).tolist(), ends, strict=True)]
        return out

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces that the newer generation does not hold; it does then, but for long ones and those beyond REMEMBERED."""
        found = dict(zip(pieces, map(self.older.get, pieces), strict=True))
        runs, single = [], []
        for piece, ids in found.items():
            if ids is None:
                body = piece[1:] if piece[0] in " \n" else piece
                (runs if self.by_piece and body.split(None, 1) == [body] else single).append(piece)
        found.update(zip(runs, self._runs(runs), strict=True))
        found.update(zip(single, self._library(single), strict=True))
        usual = len(found) <= REMEMBERED and max(map(len, found)) <= PIECE
        self.memory.update(found if usual else dict(islice((x for x in found.items() if len(x[0]) <= PIECE), REMEMBERED)))
        return list(found.values())

    def _starts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where the pieces of texts begin."""
        first = np.zeros(len(data) + 1, dtype=bool)
        if self.by_piece:
            kinds = _kinds(data)
            last = np.zeros(len(data) + 1, dtype=bool)
            last[offs[1:]] = True
            white = kinds & _WHITE
            single = np.zeros(len(data), dtype=bool)
            single[1:-1] = ((kinds[1:-1] & _BREAK) != 0) & ((white[:-2] | white[2:]) == 0)
            single &= ~last[1:]
            first[:-1] = single
            first[1:-1] |= ((kinds[1:] & _SYMBOL) != 0) & ((kinds[:-1] & _LETTER) != 0)
            first[1:] |= single & (data == 10)
            raw = data.tobytes()
            for special in [s.encode() for s in self.special]:
                if special in raw:
                    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                        if special in raw[a:b]:
                            first[a:b] = False
        first[offs] = True
        return np.flatnonzero(first[:-1])

    def encoded(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column of strings."""
        width = self.kind.itemsize
        for _, data, offs in text_chunks(column, CHUNK):
            if not len(data):
                yield from [b""] * (len(offs) - 1)
                continue
            starts = self._starts(data, offs)
            bounds = np.append(starts, len(data))
            pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
            distinct, index = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy()
            if len(self.memory) > REMEMBERED:
                self.older, self.memory = self.memory, {}
            ids = list(map(self.memory.get, distinct))
            new = [i for i, x in enumerate(ids) if x is None]
            if new:
                for i, x in zip(new, self._learn([distinct[i] for i in new]), strict=True):
                    ids[i] = x
            # Tokens of each distinct piece, of each piece, and where they go.
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // width
            begin, n_of = (np.cumsum(n) - n)[index], n[index]
            end = np.cumsum(n_of)
            at = np.repeat(begin - end + n_of, n_of)
            at += np.arange(len(at))
            out = np.frombuffer(b"".join(ids), dtype=self.kind)[at].tobytes()
            cuts = (np.append(0, end)[np.searchsorted(starts, offs)] * width).tolist()
            yield from (out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(self.encoded(pa.array(texts, pa.large_string())))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- the store -----------------------------------------------------------------------------------------


def write_store(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> DataFrame:
    """Write shards and index under path; give (doc_id, occurrence, shard, offset, n_tokens), one row for each row of docs."""
    spark = docs.sparkSession

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sequence = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer)
        end = np.array([end_id], dtype=encode.kind).tobytes()
        width = encode.kind.itemsize
        payload, size, rows = [], 0, []
        previous, occurrence = None, 0

        def flush():
            nonlocal payload, size, rows, sequence
            shard = part << 20 | sequence
            write_file(shard_path(path, shard), b"".join(payload))
            ids, occurrences, offsets, lengths = zip(*rows, strict=True)
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(occurrences, pa.int64()), pa.array([shard] * len(rows), pa.int64()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["doc_id", "occurrence", "shard", "offset", "n_tokens"],
            )
            payload, size, rows, sequence = [], 0, [], sequence + 1
            return out

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.encoded(batch.column(1)), strict=True):
                occurrence = occurrence + 1 if doc_id == previous else 0
                previous = doc_id
                payload += [ids, end]
                n = len(ids) // width + 1
                rows.append((doc_id, occurrence, size, n))
                size += n
                if size >= SHARD_IDS:
                    yield flush()
        if rows:
            yield flush()

    ordered = keyed(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    entries = cut(ordered.mapInArrow(shards, "doc_id long, occurrence long, shard long, offset long, n_tokens long"), "token-entries")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in ("doc_id", "occurrence", "shard", "offset", "n_tokens")]
        index = Index.build(key_hash(columns[0], columns[1]), *columns[2:])
        bucket = key[0].as_py()
        write_file(index_path(path, bucket), index.to_bytes())
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "n_keys": pa.array([table.num_rows], pa.int64())})

    buckets = max(1, -(-entries.count() // INDEX_KEYS))
    written = entries.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInArrow(build, "bucket int, n_keys long")
    cut(written, "token-index")
    return entries


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("doc_id", "occurrence"), F.lit(buckets)).cast("int")


def shard_path(path: str, shard: int) -> str:
    return f"{path}/shard-{shard >> 20:06d}-{shard & 0xFFFFF:04d}.ids"


def index_path(path: str, bucket: int) -> str:
    return f"{path}/index-{bucket:06d}.mph"


def lookup(keys: DataFrame, path: str, n_keys: int) -> DataFrame:
    """(doc_id, occurrence, shard, offset, n_tokens) of the keys (doc_id, occurrence) that the index holds."""
    buckets = max(1, -(-n_keys // INDEX_KEYS))

    def find(key: tuple, table: pa.Table) -> pa.Table:
        index = Index.from_bytes(read_file(index_path(path, key[0].as_py())))
        doc_id, occurrence = table.column("doc_id").to_numpy(), table.column("occurrence").to_numpy()
        found, shard, offset, length = index.lookup(key_hash(doc_id, occurrence))
        return pa.table({"doc_id": doc_id[found], "occurrence": occurrence[found], "shard": shard[found].astype(np.int64), "offset": offset[found].astype(np.int64), "n_tokens": length[found].astype(np.int64)})

    return keys.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInArrow(find, "doc_id long, occurrence long, shard long, offset long, n_tokens long")


def read_digests(located: DataFrame, path: str, wide: bool) -> DataFrame:
    """Read each document's ids from its shard: (doc_id, shard, offset, n_tokens, ids_crc32)."""
    kind = np.dtype("<u4" if wide else "<u2")

    def read(key: tuple, table: pa.Table) -> pa.Table:
        ids = np.frombuffer(read_file(shard_path(path, key[0].as_py())), dtype=kind)
        offset, n = table.column("offset").to_numpy(), table.column("n_tokens").to_numpy()
        crc = [zlib.crc32(ids[a : a + k].astype("<u4").tobytes()) for a, k in zip(offset.tolist(), n.tolist(), strict=True)]
        return pa.table({"doc_id": table.column("doc_id"), "shard": table.column("shard"), "offset": table.column("offset"), "n_tokens": table.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())})

    return located.groupBy("shard").applyInArrow(read, "doc_id long, shard long, offset long, n_tokens long, ids_crc32 long")


def store_digests(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the store, then look every document up in it: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "token-store")
    entries = write_store(docs, tokenizer, end_id, path)
    # One row for each shard file.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = entries.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("shard_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counted = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id")).groupBy("doc_id").count()
    keys = counted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("occurrence"))
    located = lookup(keys, path, entries.count())
    read = read_digests(located, path, encoder(tokenizer).kind.itemsize == 4)
    out = read.join(shards, "shard").select("doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
    return unkeyed(out)
