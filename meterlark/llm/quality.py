"""Quality classification by importance resampling.

Two n-gram generative models are counted exactly: one over the target (labelled documents of good quality that
are not toxic), one over the raw corpus (every document). A document's log importance weight is the sum, over
its n-grams, of the log ratio of the two; documents are then sampled without replacement in proportion to the
weights by Gumbel top-k.

* n-grams: runs of letters and digits (A-Z lower-cased), runs of symbols, and pairs of neighbouring runs; a run
  that repeats its predecessor is one n-gram whatever the run. An n-gram counts once in a document, so that
  neither long documents nor a word that one text repeats move the models.
* A ratio counts only by what exceeds its own standard error `z` times, so that n-grams which the bounded
  target sample cannot tell apart from raw text say nothing. What is left of chance adds up over a document
  like a random walk, so the sum is divided by the root of the number of n-grams.
* Every n-gram has a count of its own (51 bits of hash), added up by slices of the hash range whose number grows
  with the text. Those whose ratio is significant go to the scorer; the target sample bounds their number, as it
  takes some 13 target or expected documents to be significant.
* Raw counts cover every document. Only the target is a sample: at most `max_labels` labelled documents, those
  with the smallest hashes of doc_id.
* k is the number of documents whose weight reaches the threshold that separates the labelled sample best (by
  balanced accuracy). Weights are divided by `temperature` before the noise is added: at 1 this is plain
  importance resampling, towards 0 it takes the k largest weights. The noise is a hash of doc_id, so a run
  that is repeated after a lost executor draws the same sample.

Defined results: null or empty text has no n-grams and log weight 0; without labels every document is kept;
a document whose labels disagree counts by the worse; rows that repeat a doc_id each come out with the same
draw; an empty table gives an empty result; other columns are ignored.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.llm.common import _BYTE, _LOWER, NO_ID, blob, cut, fresh, gram_hashes, keyed, ranges_hash, text_chunks, unkeyed

#: An n-gram is 51 bits of hash and a last bit that tells pairs from single runs. Rows that fit in one sort key beside it.
GRAM_BITS = 52
KEY_ROWS = (1 << (63 - GRAM_BITS)) - 1
#: Bytes of text for each slice of the hash range that one group adds up, and the least number of slices.
SLICE_BYTES, LEAST_SLICES = 1 << 22, 64
#: Distinct n-grams that a task holds before it hands on its sums so far, n-grams that wait before they are added,
#: slices that are handed on at a time.
HELD, WAITING, PACKED = 1 << 20, 1 << 17, 16
#: Bytes of text whose n-grams are taken at a time.
TEXT_BYTES = 1 << 18
#: An n-gram helps to scale the raw model if the target holds it so often.
SHARED = 30
MAX_LABELS = 20_000
PRIOR, Z, TEMPERATURE = 4.0, 2.5, 0.005
_U = np.uint64

_KIND = np.full(256, 2, dtype=np.uint8)  # symbols
_KIND[[9, 10, 11, 12, 13, 32]] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_a:_b] = 1


def ngrams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct n-grams of each row in order, first n-gram of each row), a chunk of rows at a time."""
    for first, data, offs in text_chunks(column, TEXT_BYTES):
        for a in range(0, len(offs) - 1, KEY_ROWS):
            part = offs[a : a + KEY_ROWS + 1]
            yield first + a, *_row_ngrams(data[part[0] : part[-1]], part - part[0])


def _row_ngrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offs] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    solid = kind[starts] > 0 if len(data) else np.zeros(0, bool)
    starts, ends = starts[solid], ends[solid]
    runs = ranges_hash(_BYTE[_LOWER[data]], starts, ends, 0x9E3779B97F4A7C15)
    at = np.searchsorted(starts, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(at)) << GRAM_BITS
    pairs = gram_hashes(runs, 2)
    pairs[runs[1:] == runs[:-1]] = _U(1)
    inside = row[1:] == row[:-1]
    short = _U(64 - GRAM_BITS)
    one = (runs >> short).astype(np.int64) & -2
    two = (pairs >> short).astype(np.int64) | 1
    keys = np.concatenate((one + row, two[inside] + row[1:][inside] if len(two) else two))
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return keys & ((1 << GRAM_BITS) - 1), np.searchsorted(keys, np.arange(len(offs)) << GRAM_BITS)


def _sums(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order and the sum of each one's counts."""
    g, c = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(g)
    g, c = g[order], c[order]
    cuts = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    return g[cuts], np.add.reduceat(c, cuts) if len(g) else c


def _planes(values: np.ndarray) -> bytes:
    """Integers with their first bytes together, then their second ones: small ones compress well."""
    return blob(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T)


def _whole(data: bytes | pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view(np.int64).ravel()


_SLICED = "slice int, grams binary, counts binary, target boolean"


class _Held:
    """Distinct n-grams in order with their counts so far, and n-grams that still wait to be added."""

    def __init__(self) -> None:
        self.grams, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []
        self.by: list[np.ndarray] = []
        self.waiting = 0

    def add(self, grams: np.ndarray, counts: np.ndarray | None = None) -> int:
        """Once each, or as often as counts say."""
        self.new.append(grams)
        self.by += [] if counts is None else [counts]
        self.waiting += len(grams)
        if self.waiting >= WAITING:
            self.settle()
        return len(self.grams)

    def settle(self) -> None:
        """Sum up what waits and merge it in: nothing is sorted that is larger than it."""
        if not self.waiting:
            return
        if self.by:
            grams, counts = _sums(self.new, self.by)
        else:
            new = np.concatenate(self.new)
            new.sort()
            cuts = np.flatnonzero(np.append(True, new[1:] != new[:-1]))
            grams, counts = new[cuts], np.diff(cuts, append=len(new))
        self.new, self.by, self.waiting = [], [], 0
        at = np.searchsorted(self.grams, grams)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == grams[known]
        self.counts[at[known]] += counts[known]
        first = ~known
        slots = at[first] + np.arange(np.count_nonzero(first))
        old = np.ones(len(self.grams) + len(slots), dtype=bool)
        old[slots] = False
        for name, x in (("grams", grams), ("counts", counts)):
            merged = np.empty(len(old), np.int64)
            merged[slots], merged[old] = x[first], getattr(self, name)
            setattr(self, name, merged)

    def sliced(self, bits: int, target: bool) -> Iterator[pa.RecordBatch]:
        self.settle()
        cuts = np.searchsorted(self.grams, np.arange((1 << bits) + 1) << (GRAM_BITS - bits))
        full = np.flatnonzero(np.diff(cuts))
        for i in range(0, len(full), PACKED):
            part = full[i : i + PACKED]
            rows = [(cuts[x], cuts[x + 1]) for x in part]
            packed = [pa.array([_planes(f(x[a:b])) for a, b in rows], pa.binary()) for f, x in ((lambda g: np.diff(g, prepend=0), self.grams), (lambda c: c, self.counts))]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *packed, pa.array([target] * len(rows), pa.bool_())], names=["slice", "grams", "counts", "target"])
        self.__init__()


def _count(bits: int):
    """Exact counts of a task's n-grams, raw and target, packed by the slice of the hash range that adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = _Held(), _Held()
        for batch in batches:
            good = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for first, grams, at in ngrams(batch.column(1)):
                wanted = np.repeat(good[first : first + len(at) - 1], np.diff(at))
                if raw.add(grams) >= HELD:
                    yield from raw.sliced(bits, False)
                if wanted.any() and target.add(grams[wanted]) >= HELD:
                    yield from target.sliced(bits, True)
        yield from raw.sliced(bits, False)
        yield from target.sliced(bits, True)

    return run


def least_raw(prior: float, z: float) -> int:
    """An n-gram of fewer documents than this is never significant: neither its target nor its expected count exceeds its raw one."""
    if prior <= 0 or z > 2 * math.sqrt(prior):
        return 1
    n = 1
    while math.log((n + prior) / prior) <= z * math.sqrt(1 / (n + prior) + 1 / prior):
        n += 1
    return n


_COUNTED = "gram long, raw long, target long, scaling boolean"


def _add_slices(least: int):
    """Totals of a slice: n-grams of `least` documents or more, and those that may scale the raw model."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {False: _Held(), True: _Held()}
        for batch in batches:
            for grams, counts, target in zip(*(batch.column(x) for x in ("grams", "counts", "target")), strict=True):
                found[target.as_py()].add(np.cumsum(_whole(grams.as_buffer())), _whole(counts.as_buffer()))
        for x in found.values():
            x.settle()
        (grams, raw), (some, n) = ((x.grams, x.counts) for x in found.values())
        target = np.zeros(len(grams), np.int64)
        target[np.searchsorted(grams, some)] = n
        scaling = np.zeros(len(grams), bool)
        for kind in (0, 1):
            of = (grams & 1) == kind
            if target[of].any():
                scaling |= of & (target >= min(SHARED, target[of].max()))
        kept = (raw >= least) | scaling
        yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (grams, raw, target, scaling)], names=["gram", "raw", "target", "scaling"])

    return run


def raw_scale(raw: np.ndarray, target: np.ndarray) -> float | None:
    """What scales the raw model to the n-grams that both share: the median ratio of a target n-gram, else what only
    junk holds would lift every ordinary n-gram, and long documents with it. None without target n-grams."""
    if not len(target) or not target.max():
        return None
    shared = target >= min(SHARED, target.max())
    order = np.argsort(target[shared] / np.maximum(raw[shared], 1), kind="stable")
    weight = np.cumsum(target[shared][order])
    middle = np.searchsorted(weight, weight[-1] / 2)
    return target[shared][order][middle] / max(raw[shared][order][middle], 1)


def log_ratios(raw: np.ndarray, target: np.ndarray, scale: float, prior: float = PRIOR, z: float = Z) -> np.ndarray:
    """Log of target over raw probability of each n-gram, shrunk to 0 where it is not significant."""
    expected = raw * scale
    ratio = np.log((target + prior) / (expected + prior))
    error = np.sqrt(1 / (target + prior) + 1 / (expected + prior))
    return np.sign(ratio) * np.maximum(0.0, np.abs(ratio) - z * error)


def _significant(scales: tuple[float | None, float | None], z: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, raw, target = (batch.column(x).to_numpy() for x in ("gram", "raw", "target"))
            out = np.zeros(len(gram))
            for kind, scale in enumerate(scales):  # single runs and pairs are a model each
                of = (gram & 1) == kind
                if scale is not None:
                    out[of] = log_ratios(raw[of], target[of], scale, z=z)
            yield pa.RecordBatch.from_arrays([pa.array(gram[out != 0]), pa.array(out[out != 0])], names=["gram", "ratio"])

    return run


def gram_counts(texts: DataFrame, least: int) -> DataFrame:
    """gram, raw, target, scaling of texts(doc_id, text, good): every n-gram counted exactly, rare ones without bearing left out."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_SLICES - 1, size // SLICE_BYTES).bit_length()
    return texts.mapInArrow(_count(bits), _SLICED).groupBy("slice").applyInArrow(_add_slices(least), _COUNTED)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ratios = model.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, grams, at in ngrams(batch.column(1)):
                place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                total = np.concatenate(([0.0], np.cumsum(np.where(known[place] == grams, ratios[place], 0.0))))
                out[first : first + len(at) - 1] = (total[at[1:]] - total[at[:-1]]) / np.sqrt(np.maximum(1, np.diff(at)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(out, 6))], names=["doc_id", "log_weight"])

    return run


def best_threshold(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight that separates good from other documents with the best balanced accuracy, midway between neighbours."""
    if not len(weights) or good.all():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order].astype(float)
    rejected_good = np.concatenate(([0.0], np.cumsum(g)))
    rejected_bad = np.concatenate(([0.0], np.cumsum(1 - g)))
    balance = 1 - rejected_good / max(g.sum(), 1) + rejected_bad / max((1 - g).sum(), 1)
    balance[1:-1][w[1:] == w[:-1]] = -1  # equal weights are not parted
    at = int(np.argmax(balance))
    if at == 0:
        return -np.inf
    return float(w[at - 1] + 1e-6 if at == len(w) else (w[at - 1] + w[at]) / 2)


def gumbel(doc_id: Column, seed: int = 0) -> Column:
    """Standard Gumbel noise from a hash of doc_id."""
    bits = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 12)
    return -F.log(-F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 52))))


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of column `key`, by narrowing a histogram; no row is collected."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    bins, above = 4096, 0
    while high > low:
        width = (high - low) / bins
        if low + width == low:
            break
        slot = F.least(F.floor((F.col("key") - low) / F.lit(width)), F.lit(bins - 1)).cast("int")
        counts = dict(keys.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(slot.alias("s")).count().collect())  # at most 4096 rows
        for s in sorted(counts, reverse=True):
            if above + counts[s] >= k:
                break
            above += counts[s]
        if counts[s] <= 1 or len(counts) == 1 and counts[s] > 1 and width == 0:
            inside = keys.where((F.col("key") >= low) & (F.col("key") <= high) & (slot == s)).agg(F.min("key")).first()[0]
            return float(inside)
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high) & (slot == s)).agg(F.min("key"), F.max("key")).first()
        low, high = inside
    return float(low)


def quality(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, temperature: float = TEMPERATURE, z: float = Z) -> DataFrame:
    """doc_id, log_weight, kept: one row for each row of docs."""
    spark = docs.sparkSession
    texts = keyed(docs)
    judged = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    judged = judged.select("doc_id", (F.coalesce("q", F.lit(0)) >= 1).alias("clean"), (F.coalesce("t", F.lit(1)) == 0).alias("mild"))
    # Bounded by max_labels rows, whatever the input.
    sample = cut(judged.select("doc_id", (F.col("clean") & F.col("mild")).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels), "label-sample")
    marked = texts.join(F.broadcast(sample), "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    counted = cut(gram_counts(marked, least_raw(PRIOR, z)), "gram-counts")
    # Bounded like what follows by the labelled sample: an n-gram that scales or is significant has its share of target n-grams.
    shared = counted.where("scaling").select((F.col("gram") % 2).alias("kind"), "raw", "target").toPandas()
    scales = tuple(raw_scale(*(shared.loc[shared["kind"] == kind, c].to_numpy() for c in ("raw", "target"))) for kind in (0, 1))
    found = counted.mapInArrow(_significant(scales, z), "gram long, ratio double").toPandas().sort_values("gram")
    # The last n-gram is none: there is always one to look at.
    model = spark.sparkContext.broadcast((np.append(found["gram"].to_numpy(dtype=np.int64), 2**63 - 1), np.append(found["ratio"].to_numpy(dtype=float), 0.0)))
    weighted = cut(texts.mapInArrow(_score(model), "doc_id long, log_weight double"), "log-weights")
    known: pd.DataFrame = weighted.join(F.broadcast(sample), "doc_id").select("log_weight", "good").toPandas()  # at most max_labels documents
    threshold = best_threshold(known["log_weight"].to_numpy(), known["good"].to_numpy(dtype=bool))
    keys = weighted.withColumn("key", F.col("log_weight") / F.lit(temperature) + gumbel(F.col("doc_id")))
    k = keys.count() if threshold == -np.inf else weighted.where(F.col("log_weight") >= threshold).count()
    if k <= 0:
        kept = F.lit(False)
    elif threshold == -np.inf:
        kept = F.lit(True)
    else:
        kept = F.col("key") >= kth_largest(keys, k)
    out = keys.select("doc_id", "log_weight", kept.alias("kept"))
    return unkeyed(out)


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that quality() keeps, all columns as they are."""
    key = fresh(docs, "_key")
    kept = quality(docs, labels, **options).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(key)).distinct()
    marked = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    return marked.join(kept, key, "left_semi").select(*docs.columns)
