"""Periodic run detection: the maximal repetitions of word sequences, found by the runs theorem.

A run is a stretch of consecutive words that repeats with its smallest period at least `min_exponent` times and that
no neighbouring word extends. By the runs theorem each run holds, at one of its positions, the longest Lyndon word
that starts there under one of two opposite orders of the words. So, for each document:

1. Words become integers (dictionary codes of their bytes: equality is exact). Suffixes are sorted by prefix
   doubling; the tables of ranks by length 1, 2, 4, ... give the LCP of neighbouring suffixes.
2. The longest Lyndon word at i ends before the next smaller value of the inverse suffix array; under the opposite
   order, with the end of the text as the largest symbol, before the next larger value.
3. Each such word of period p is extended to the right by the LCP of i and i + p, a minimum over a range of the LCP
   array, from a sparse table; to the left by the same on the reversed words. Words whose run would be too short
   drop out as soon as a few comparisons show it, and only documents with a word left are sorted in reverse.

Many documents are worked on together in numpy, `CHUNK_BYTES` of text at a time (ranks never mix documents); a longer
text comes alone. Nothing is shuffled. Memory is some 300 bytes for each word of the chunk.

Defined results: words are runs of bytes other than [\\x20\\x09-\\x0D]; a null or empty text has no words, no runs and
an empty collapsed text; fewer than min_length words have no runs; a null doc_id and repeated rows are rows like any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.llm.common import CHUNK_BYTES

MIN_LENGTH, MIN_EXPONENT = 12, 2
#: Words compared one by one before a run is extended by LCP.
FIRST_LOOKS = 12
RUNS = "array<struct<start:long,length:long,period:long>>"
RESULT = f"doc_id long, n_words long, runs {RUNS}, collapsed string"


class Suffixes:
    """Suffix order and LCP of documents laid end to end; a suffix ends with its document."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray, document: np.ndarray):
        n = len(codes)
        self.n = n
        rank = codes.astype(np.int64)
        levels, step = [], 1
        # Ranks of blocks of 1, 2, 4, ... words; a block that its document cuts short is smaller than what it begins.
        place = np.arange(n)
        while True:
            levels.append(rank.astype(np.int32))
            after = np.zeros(n, dtype=np.int64)
            inside = np.flatnonzero(place + step < ends)
            after[inside] = rank[inside + step] + 1
            key = rank * (int(after.max(initial=0)) + 1) + after
            values, fresh_rank = np.unique(key, return_inverse=True)
            grown = fresh_rank.astype(np.int64)
            step *= 2
            if len(inside) == 0 or self._settled(grown, len(values), document):
                rank = grown
                break
            rank = grown
        order = np.lexsort((rank, document))
        self.order = order
        self.inverse = np.empty(n, dtype=np.int64)
        self.inverse[order] = place
        self.ends = ends
        lcp = self._common(levels, order[:-1], order[1:], document) if n > 1 else np.zeros(0, np.int64)
        # table[k][r]: the smallest of lcp[r : r + 2**k], where lcp[r] is that of suffixes r and r + 1.
        self.table = [lcp.astype(np.int32)]
        while (1 << len(self.table)) <= len(lcp):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _settled(rank: np.ndarray, distinct: int, document: np.ndarray) -> bool:
        """Whether no two suffixes of one document share a rank."""
        if distinct == len(rank):
            return True
        pair = np.sort(rank * (int(document[-1]) + 1) + document)
        return not (pair[1:] == pair[:-1]).any()

    def _common(self, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, document: np.ndarray) -> np.ndarray:
        """Words that suffixes a and b of one document share at their start, by the ranks of ever shorter blocks."""
        out = np.zeros(len(a), dtype=np.int64)
        same = document[a] == document[b]
        end = self.ends[a]
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + out, b + out
            fits = np.flatnonzero(same & (np.maximum(x, y) + (1 << k) <= end))
            fits = fits[levels[k][x[fits]] == levels[k][y[fits]]]
            out[fits] += 1 << k
        return out

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that suffixes a and b (a != b, of one document) share, by range minimum."""
        x, y = self.inverse[a], self.inverse[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            row = self.table[level]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << level)])
        return out


def next_smaller(values: list[int], start: int, end: int, out: list[int]) -> None:
    """out[i] for start <= i < end: the first j > i with values[j] < values[i], else end."""
    for i in range(end - 1, start - 1, -1):
        v, j = values[i], i + 1
        while j < end and values[j] > v:
            j = out[j]
        out[i] = j


def _lyndon_ends(inverse: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the longest Lyndon words at each position, under both orders."""
    found = []
    for values in (inverse, -inverse):
        listed, out = values.tolist(), [0] * len(values)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            next_smaller(listed, a, b, out)
        found.append(np.array(out, dtype=np.int64))
    return found[0], found[1]


def find_runs(codes: np.ndarray, at: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (document, start, length, period), sorted, of documents codes[at[d]:at[d + 1]]; start counts from 0."""
    none = np.zeros((0, 4), dtype=np.int64)
    n = len(codes)
    if n < 2:
        return none
    sizes = np.diff(at)
    document = np.repeat(np.arange(len(sizes)), sizes)
    first, ends = at[:-1][document], at[1:][document]
    forward = Suffixes(codes, ends, document)
    place = np.arange(n)
    roots = []
    for end in _lyndon_ends(forward.inverse, at):
        inside = end < ends  # a word that the document's end cuts off has nothing to repeat in
        roots.append(np.stack((place[inside], end[inside])))
    i, j = np.concatenate(roots, axis=1)
    if not len(i):
        return none
    # Equal words to the right from (i, j) and to the left from (i - 1, j - 1) must make up what the root lacks.
    need = np.maximum(min_length, min_exponent * (j - i)) - (j - i)
    right = forward.extension(i, j)
    open_ = np.flatnonzero(_left_possible(codes, i, j, first[i], need - right))
    i, j, right = i[open_], j[open_], right[open_]
    if not len(i):
        return none
    left = _left_extension(codes, at, document, i, j)
    start, period = i - left, j - i
    length = left + period + right
    good = length >= np.maximum(min_length, min_exponent * period)
    rows = np.stack((document[i], start - first[i], length, period))[:, good]
    return np.unique(rows.T[:, [0, 1, 3, 2]], axis=0)[:, [0, 1, 3, 2]]


def _left_possible(codes: np.ndarray, i: np.ndarray, j: np.ndarray, first: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether at least `need` words may match to the left: false where one of the first few looks shows that they do not."""
    out = i - first >= need
    at = np.flatnonzero(out & (need > 0))
    for k in range(1, FIRST_LOOKS + 1):
        differs = codes[i[at] - k] != codes[j[at] - k]
        out[at[differs]] = False
        at = at[~differs]
        at = at[need[at] > k]
        if not len(at):
            break
    return out


def _left_extension(codes: np.ndarray, at: np.ndarray, document: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Equal words that end at i - 1 and j - 1, by the suffixes of the reversed documents."""
    wanted = np.unique(document[i])
    sizes = np.diff(at)[wanted]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    reverse = np.concatenate([codes[at[d] : at[d + 1]][::-1] for d in wanted.tolist()])
    of = np.repeat(np.arange(len(wanted)), sizes)
    backward = Suffixes(reverse, starts[1:][of], of)
    local = np.searchsorted(wanted, document[i])
    # Word w of document d is word at[d + 1] - 1 - w of its reverse.
    flip = lambda p: starts[local] + at[wanted[local] + 1] - 1 - p
    out = np.zeros(len(i), dtype=np.int64)
    inner = np.flatnonzero(i > at[:-1][document[i]])
    out[inner] = backward.extension(flip(i - 1)[inner], flip(j - 1)[inner])
    return out


def kept_words(n: int, at: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which words stay when every run keeps its first period only."""
    cover = np.zeros(n + 1, dtype=np.int64)
    start = at[:-1][runs[:, 0]] + runs[:, 1]
    np.add.at(cover, start + runs[:, 3], 1)
    np.add.at(cover, start + runs[:, 2], -1)
    return np.cumsum(cover[:-1]) == 0


def _chunks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > CHUNK_BYTES:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def runs_of_texts(texts: list[bytes], min_length: int, min_exponent: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(words, rows of start, length and period, collapsed text) of each text."""
    words: list[bytes] = []
    at = [0]
    for text in texts:
        words += text.split()  # of bytes: at exactly the six characters of white space
        at.append(len(words))
    at = np.array(at, dtype=np.int64)
    kind = pa.large_binary()
    codes = pc.dictionary_encode(pa.array(words, kind)).indices.to_numpy(zero_copy_only=False).astype(np.int64) if words else np.zeros(0, np.int64)
    runs = find_runs(codes, at, min_length, min_exponent)
    stay = kept_words(len(words), at, runs)
    cuts = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    for d in range(len(texts)):
        a, b = int(at[d]), int(at[d + 1])
        own = words[a:b]
        if cuts[d] < cuts[d + 1]:
            own = [own[k] for k in np.flatnonzero(stay[a:b]).tolist()]
        yield b - a, runs[cuts[d] : cuts[d + 1], 1:], b" ".join(own)


def _found(min_length: int, min_exponent: int):
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.binary() if pa.types.is_string(batch.column(1).type) else pa.large_binary())
            first = 0
            for chunk in _chunks(x.as_py() for x in column):
                sizes, offsets, flat, collapsed = [], [0], [], []
                for n, runs, text in runs_of_texts(chunk, min_length, min_exponent):
                    sizes.append(n)
                    flat.append(runs)
                    offsets.append(offsets[-1] + len(runs))
                    collapsed.append(text)
                rows = np.concatenate(flat)
                structs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(item))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(chunk)), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )
                first += len(chunk)

    return run


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed (the words that stay, joined by one space) of each row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_found(min_length, min_exponent), RESULT)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of one document in ten repeat with a period from some word on.

    With h the crc32 of the decimal doc_id, g = floor(h / 10) and n words: where h % 10 = 0 and n > 0, each word i >= a
    becomes word a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null doc_id has no h.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", g.alias("g"), F.when(h % 10 == 0, words).alias("w"))
    placed = split.withColumn("a", F.when(F.size("w") > 0, F.col("g") % F.size("w"))).withColumn("p", 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8)))
    repeated: Column = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.element_at("w", (F.col("a") + F.pmod(i - F.col("a"), F.col("p")) + 1).cast("int"))))
    return placed.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))
