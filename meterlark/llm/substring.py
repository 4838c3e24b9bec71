"""Substring deduplication over word suffixes, by prefix-partitioned suffix trees.

A window is `window` consecutive words of one document. A word goes if a window that covers it has a word
sequence that also starts earlier (smaller doc_id, or the same document further left).

1. Anchors. Each document is read once; of each run of windows the smallest 6-gram hash is an anchor, so two
   equal windows share one. Anchors are dealt, packed, to the owner of their hash range, which tells the
   documents whose anchors repeat. Within a batch an anchor travels once, the other documents are told at once.
2. Candidate suffixes are those whose first `window` words hold a repeated anchor; no others can be equal.
3. Prefixes of 1, 2, 4, 8 words and of the whole window are counted in hashed slots. A suffix joins the group
   of its shortest prefix that at most `group` suffixes share, so groups have prefixes of variable length and
   fit in memory. Prefixes that stay frequent at full length need no deeper tree: equal windows of a batch
   are folded to the earliest before they travel, so such a group gets a row for each batch at most.
4. Each group is sorted into its tree: suffixes equal in 96 bits over the window lie under one internal node
   of at least that depth, a repeat. All but the earliest suffix of a node are repeated windows.

Defined results: null, empty or wordless texts have no words and keep the empty text; rows that share a doc_id
are one document (equal positions are one occurrence) and each comes out; an empty table gives an empty
result; other columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.llm.common import blob, cut, deal_by_document, gather_documents, gram_hashes, keyed, mix, owner_cuts, partitions, row_of, sliding, text_chunks, unkeyed, word_hashes

WINDOW, GRAM = 20, 6
LEVELS = (1, 2, 4, 8)
#: Suffixes that a group of one prefix holds before the prefix is made longer.
GROUP = 1 << 20
_U = np.uint64


def _windows(column: pa.Array, window: int, gram: int):
    """For each chunk of texts: first row, word hashes, each row's first word, starts and rows of its windows, their anchors."""
    for first, data, offs in text_chunks(column):
        words, at = word_hashes(data, offs)
        row = row_of(at)
        start = np.arange(len(words))
        valid = start + window <= at[1:][row]
        grams = gram_hashes(words, gram)
        lowest = sliding(grams, window - gram + 1)
        valid = valid[: len(lowest)]
        yield first, words, at, np.flatnonzero(valid), row, grams, lowest, valid


def _anchors(grams: np.ndarray, lowest: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Positions of the k-grams that are smallest in some window, ties included."""
    seen = np.where(valid, lowest, _U(0))
    padded = np.concatenate((np.zeros(width - 1, _U), seen, np.zeros(width - 1, _U)))
    return np.flatnonzero(sliding(padded, width, np.maximum)[: len(grams)] == grams)


_NAMES = ["part", "doc_id", "n_words", "digest", "values", "docs", "settled"]
_SCANNED = "part int, doc_id long, n_words long, digest string, values binary, docs binary, settled boolean"


def _scan(window: int, gram: int, parts: int):
    width = window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            values, rows = [], []
            for first, words, at, _, row, grams, lowest, valid in _windows(batch.column(1), window, gram):
                where = _anchors(grams, lowest, valid, width)
                values.append(grams[where])
                rows.append(row[where] + first)
            counts, digests = [], []
            for text in batch.column(1).to_pylist():
                split = text.encode("utf-8", "surrogatepass").split()
                counts.append(len(split))
                digests.append(hashlib.sha256(b" ".join(split)).hexdigest())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.bool_())], names=_NAMES)
            v = np.concatenate(values) if values else np.zeros(0, _U)
            d = ids[np.concatenate(rows)] if rows else np.zeros(0, np.int64)
            order = np.lexsort((d, v))
            v, d = v[order], d[order]
            new = np.append(True, v[1:] != v[:-1]) if len(v) else np.zeros(0, bool)
            again = ~new | (np.append(~new[1:], False) if len(v) else new)  # held at least twice in this batch
            told = deal_by_document(v[again], d[again], parts)
            m = told.num_rows
            yield pa.RecordBatch.from_arrays([told.column(0), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), told.column(2), told.column(1), pa.array([True] * m, pa.bool_())], names=_NAMES)
            v, d = v[new], d[new]
            owner = ((v >> _U(40)) % _U(parts)).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            v, d, owner = v[order], d[order], owner[order]
            cuts, ends = owner_cuts(owner)
            m = len(cuts)
            packed = [pa.array([blob(x[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary()) for x in (v, d)]
            yield pa.RecordBatch.from_arrays([pa.array(owner[cuts], pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), *packed, pa.array([False] * m, pa.bool_())], names=_NAMES)

    return run


def _repeated(parts: int):
    """By owner: the anchors that several batches hold, dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, docs = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for batch in batches:
            values += [np.frombuffer(x, dtype=_U) for x in batch.column("values").to_pylist()]
            docs += [np.frombuffer(x, dtype=np.int64) for x in batch.column("docs").to_pylist()]
        v, d = np.concatenate(values), np.concatenate(docs)
        values.clear()
        docs.clear()
        order = np.argsort(v, kind="stable")
        v, d = v[order], d[order]
        if len(v):
            same = v[1:] == v[:-1]
            again = np.append(False, same) | np.append(same, False)
            yield deal_by_document(v[again], d[again], parts)

    return run


def _candidates(column: pa.Array, packed: list[bytes], window: int, gram: int):
    """For each chunk: first row, word hashes, first words, starts of candidate windows and their rows."""
    for first, words, at, starts, row, _, lowest, _ in _windows(column, window, gram):
        held = [np.frombuffer(x, dtype=_U) for x in packed[first : first + len(at) - 1]]
        wanted = np.unique(np.concatenate(held)) if held else np.zeros(0, _U)
        low = lowest[starts]
        if len(wanted):
            found = np.minimum(np.searchsorted(wanted, low), len(wanted) - 1)
            starts = starts[wanted[found] == low]
        else:
            starts = starts[:0]
        yield first, words, at, starts, row[starts]


def _prefix_slots(words: np.ndarray, starts: np.ndarray, window: int, slots: int) -> list[np.ndarray]:
    """The slot of each suffix's prefix at each level, the whole window last."""
    return [(gram_hashes(words, k)[starts] % _U(slots)).astype(np.int64) for k in (*LEVELS, window)]


def _count_prefixes(window: int, gram: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LEVELS) + 1, slots), dtype=np.int64)
        for batch in batches:
            for _, words, _, starts, _ in _candidates(batch.column(1), batch.column(2).to_pylist(), window, gram):
                for level, at in enumerate(_prefix_slots(words, starts, window, slots)):
                    total[level] += np.bincount(at, minlength=slots)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([blob(x) for x in total], pa.binary())], names=["level", "n"])

    return run


def _add_counts(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column("n").to_pylist():
            n = np.frombuffer(x, dtype=np.int64)
            total = n.copy() if total is None else total + n
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([blob(total)], pa.binary())], names=["level", "n"])


def prefix_groups(spark: SparkSession, counted: DataFrame, slots: int, parts: int, group: int) -> np.ndarray:
    """The partition of each (level, slot), -1 where the prefix must be longer.

    The table has (levels * slots) entries, a bound that the partitions set and not the rows.
    """
    counts = np.zeros((len(LEVELS) + 1, slots), dtype=np.int64)
    for level, n in counted.groupBy("level").applyInArrow(_add_counts, "level int, n binary").collect():  # a row for each level
        counts[level] = np.frombuffer(n, dtype=np.int64)
    limit = min(group, max(1, int(counts[-1].sum()) // (4 * parts)))
    level, slot = np.indices(counts.shape)
    spread = (mix((level.astype(_U) << _U(40)) | slot.astype(_U)) % _U(parts)).astype(np.int32)
    spread[:-1][counts[:-1] > limit] = -1
    return spread


def _suffixes(window: int, gram: int, slots: int, parts: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = table.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            packed = batch.column(2).to_pylist()
            k1, k2, doc, pos, part = [], [], [], [], []
            for first, words, at, starts, row in _candidates(batch.column(1), packed, window, gram):
                k1.append(gram_hashes(words, window)[starts])
                k2.append((gram_hashes(words, window, seed=1)[starts] >> _U(32)).astype(np.uint32))
                doc.append(ids[row + first])
                pos.append((starts - at[:-1][row]).astype(np.uint32))
                owner = np.full(len(starts), -1, dtype=np.int32)
                for level, slot in enumerate(_prefix_slots(words, starts, window, slots)):
                    owner = np.where(owner < 0, spread[level][slot], owner)
                part.append(owner)
            if not k1:
                continue
            columns = [np.concatenate(x) for x in (k1, k2, doc, pos, part)]
            (doc, pos), columns = _fold(*columns)
            # What an equal window of this batch precedes is settled; it passes through some group as it is.
            settled = deal_by_document(pos, doc, parts)
            none = pa.nulls(settled.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([settled.column(0), none, none, settled.column(1), settled.column(2)], names=_SUFFIX_NAMES)
            a, b, d, p, owner = columns
            # In document order, documents repeat and positions differ by little, which packs well.
            order = np.lexsort((p, d, owner))
            a, b, d, p, owner = (x[order] for x in (a, b, d, p, owner))
            cuts, ends = owner_cuts(owner)
            blobs = [pa.array([blob(x[i:j]) for i, j in zip(cuts, ends, strict=True)], pa.binary()) for x in (a, b, d)]
            steps = pa.array([blob(np.diff(p[i:j], prepend=np.uint32(0))) for i, j in zip(cuts, ends, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(owner[cuts], pa.int32()), *blobs, steps], names=_SUFFIX_NAMES)

    return run


_SUFFIX_NAMES = ["part", "k1", "k2", "docs", "pos"]
_SUFFIXES = "part int, k1 binary, k2 binary, docs binary, pos binary"


def _fold(k1, k2, doc, pos, *more):
    """((doc, pos) of suffixes that an equal window precedes, all columns of the earliest of each window)."""
    order = np.lexsort((pos, doc, k2, k1))
    k1, k2, doc, pos, *more = (x[order] for x in (k1, k2, doc, pos, *more))
    if not len(k1):
        return (doc, pos), (k1, k2, doc, pos, *more)
    first = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = (doc != doc[head]) | (pos != pos[head])  # rows that repeat a document repeat its positions
    return (doc[later], pos[later]), tuple(x[first] for x in (k1, k2, doc, pos, *more))


def _subtrees(parts: int):
    """By group: the positions of suffixes under a node of window depth, but for the earliest, dealt by document."""
    kinds = (_U, np.uint32, np.int64, np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in kinds]
        for batch in batches:
            settled = batch.filter(pc.is_null(batch.column("k1")))
            if settled.num_rows:
                yield settled.select(["part", "docs", "pos"]).rename_columns(["part", "docs", "values"])
            batch = batch.filter(pc.is_valid(batch.column("k1")))
            for into, name, kind in zip(found, ("k1", "k2", "docs", "pos"), kinds, strict=True):
                into += [np.frombuffer(x, dtype=kind) for x in batch.column(name).to_pylist()]
        found[3] = [np.cumsum(x, dtype=np.uint32) for x in found[3]]
        columns = [np.concatenate(x) for x in found]
        found.clear()
        (doc, pos), _ = _fold(*columns)
        if len(doc):
            yield deal_by_document(pos, doc, parts)

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, removed, digests = [], [], [], []
            for doc_id, text, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                split = text.encode("utf-8", "surrogatepass").split()
                edge = np.zeros(len(split) + window + 1, dtype=np.int64)
                starts = np.unique(np.frombuffer(packed, dtype=np.uint32)).astype(np.int64)
                starts = starts[starts < len(split)]
                edge[starts] += 1
                edge[starts + window] -= 1
                gone = np.cumsum(edge)[: len(split)] > 0
                ids.append(doc_id)
                counts.append(len(split))
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join([w for w, g in zip(split, gone.tolist(), strict=True) if not g])).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


_DEALT = "part int, docs binary, values binary"


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row for each row of docs."""
    spark = docs.sparkSession
    parts = partitions(spark)
    texts = keyed(docs)
    scanned = cut(texts.mapInArrow(_scan(window, gram, parts), _SCANNED), "anchors")
    owned = scanned.where("part IS NOT NULL AND NOT settled").select("part", "values", "docs").repartition(parts, "part")
    told = owned.mapInArrow(_repeated(parts), _DEALT).unionByName(scanned.where("settled").select("part", "docs", "values"))
    hits = gather_documents(told, _U, parts)
    held = cut(texts.join(hits, "doc_id"), "candidate-texts")

    slots = 1 << max(8, (16 * parts - 1).bit_length())
    counted = held.mapInArrow(_count_prefixes(window, gram, slots), "level int, n binary")
    table = spark.sparkContext.broadcast(prefix_groups(spark, counted, slots, parts, group))
    suffixes = held.mapInArrow(_suffixes(window, gram, slots, parts, table), _SUFFIXES).repartition(parts, "part")
    repeats = gather_documents(suffixes.mapInArrow(_subtrees(parts), _DEALT), np.uint32, parts)
    touched = cut(held.select("doc_id", "text").join(repeats, "doc_id").mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string"), "removed")
    rows = scanned.where("n_words IS NOT NULL").select("doc_id", "n_words", "digest")
    whole = rows.join(touched.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"))
    return unkeyed(whole.unionByName(touched))
