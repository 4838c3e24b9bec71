"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: hashed n-grams of 1 to 3 code points of the lower-cased text, term frequency (share of the
  document's n-grams) times inverse document frequency. Document frequencies cover every training row.
* Weights are trained with follow-the-regularised-leader and elastic-net penalties (FTRL-proximal) on at most
  `max_train` labelled training rows, those with the smallest hashes of doc_id; whole texts, never prefixes.
  Rows that share a doc_id count one by one.
* A tenth of that sample is left out of the training and sets the temperature of the softmax.

A prediction reads the text alone. Training reads text and lang of rows whose crc32(doc_id as text) is not a
multiple of 5; the others are held out.

Defined results: null text, and text without a letter, is `und` with score 0; without any training row every
text is `und`; rows that repeat a doc_id each come out; an empty table gives an empty result; other columns
are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.llm.common import NO_ID, blob, cut, seeded, text_chunks, unkeyed

BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
MAX_TRAIN, FOLDS = 4_000, 5
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-4, 1e-4, 4
_U = np.uint64
_SALT = seeded(31, 8)
_LETTER = regex.compile(r"\p{L}")


def code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and each row's first one."""
    start = (data & 0xC0) != 0x80
    at = np.flatnonzero(start)
    code = data[at].astype(np.uint64)
    long = np.flatnonzero(code >= 0xC0)
    lead = code[long]
    size = 2 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
    value = lead & (np.uint64(0x7F) >> size.astype(_U))
    for i in (1, 2, 3):
        more = size > i
        value[more] = (value[more] << _U(6)) | (data[np.minimum(at[long[more]] + i, len(data) - 1)] & 0x3F)
    code[long] = value
    return code, np.searchsorted(at, offs)


def gram_buckets(codes: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point but the last order - 1."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code = codes[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, order):
            code = (code << _U(21)) | codes[i : i + n]
        mixed = (code + _SALT[order]) * _U(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return ((mixed >> _U(40)) % _U(buckets)).astype(np.int64)


def document_grams(column: pa.Array, buckets: int) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """(first row, for each order (buckets, starts, ends by row)), a chunk of rows at a time."""
    for first, data, offs in text_chunks(pc.utf8_lower(column)):
        codes, at = code_points(data, offs)
        yield first, [(gram_buckets(codes, k, buckets), at[:-1], np.maximum(at[1:] - k + 1, at[:-1])) for k in ORDERS]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, TF-IDF values) of one text."""
    grams = np.concatenate([g for _, orders in document_grams(pa.array([text], pa.string()), len(idf)) for g, _, _ in orders])
    at, counts = np.unique(grams, return_counts=True)
    return at, counts * idf[at] / max(1, len(grams))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, n_classes: int, buckets: int, seed: int = 1) -> np.ndarray:
    """Weights (buckets + 1, classes), the last row being the bias; proximal FTRL over shuffled rows."""
    z, n = np.zeros((buckets + 1, n_classes)), np.zeros((buckets + 1, n_classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)).tolist():
            at, x = rows[i]
            at, x = np.append(at, buckets), np.append(x * SCALE, 1.0)
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[classes[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(buckets + 1))


#: TF-IDF values of long texts are small; all are brought to this scale.
SCALE = 50.0


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The softmax temperature with the least log loss, from a fixed grid."""
    best, least = 1.0, np.inf
    for t in np.exp(np.linspace(np.log(0.05), np.log(20), 80)):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        loss = -np.mean(s[np.arange(len(s)), classes] - np.log(np.exp(s).sum(axis=1)))
        if loss < least:
            best, least = float(t), loss
    return best


def _count(buckets: int):
    """Document frequencies of this task's training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(buckets, dtype=np.int64), 0
        seen = np.zeros(buckets, dtype=bool)
        for batch in batches:
            rows += batch.num_rows
            for _, orders in document_grams(batch.column(0), buckets):
                for r in range(len(orders[0][1])):
                    seen[:] = False
                    for grams, a, b in orders:
                        seen[grams[a[r] : b[r]]] = True
                    total += seen
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([blob(total)], pa.binary())], names=["n", "counts"])

    return run


def _merge(buckets: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(buckets, dtype=np.int64), 0
        for batch in batches:
            rows += sum(batch.column("n").to_pylist())
            for x in batch.column("counts").to_pylist():
                total += np.frombuffer(x, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([blob(total)], pa.binary())], names=["n", "counts"])

    return run


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, bias, heat = model.value
        for batch in batches:
            column = batch.column(1)
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            if names:
                for first, orders in document_grams(column, len(table)):
                    m = len(orders[0][1])
                    total, count = np.zeros((m, len(names))), np.zeros(m)
                    for grams, a, b in orders:
                        sums = np.zeros((len(grams) + 1, len(names)))
                        np.cumsum(table[grams], axis=0, out=sums[1:])
                        total += sums[np.minimum(b, len(grams))] - sums[np.minimum(a, len(grams))]
                        count += b - a
                    logits = (total / np.maximum(count, 1)[:, None] + bias) / heat
                    p = np.exp(logits - logits.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best[first : first + m], score[first : first + m] = p.argmax(axis=1), p.max(axis=1)
            found = []
            for i, text in enumerate(column.to_pylist()):
                if not text or best[i] < 0 or not _LETTER.search(text):
                    found.append("und")
                    score[i] = 0.0
                else:
                    found.append(names[best[i]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(np.round(score, 6))], names=["doc_id", "lang_pred", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def train(docs: DataFrame, max_train: int = MAX_TRAIN, buckets: int = BUCKETS):
    """(languages, weights times IDF (buckets, languages), bias, temperature)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    texts = rows.select(F.col("text").cast("string").alias("text"))
    parts = texts.mapInArrow(_count(buckets), "n long, counts binary")
    # Sums by eighths of the tasks first, so that no task adds up all of them.
    parts = parts.withColumn("g", F.spark_partition_id() % 8).groupBy("g").applyInArrow(_merge(buckets), "n long, counts binary")
    counts, n = np.zeros(buckets, dtype=np.int64), 0
    for k, x in parts.collect():  # 8 rows
        counts, n = counts + np.frombuffer(x, dtype=np.int64), n + k
    idf = np.log((1 + n) / (1 + counts)) + 0.1
    chosen = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    chosen = cut(chosen, "language-sample").select("doc_id").distinct()  # bounded by max_train
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select(F.xxhash64("doc_id").alias("h"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vector(x, idf) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64()))], names=["h", "lang", "at", "x"])

    # A doc_id may have many rows: max_train of them in all come to the driver.
    vectored = sample.mapInArrow(vectors, "h long, lang string, at array<int>, x array<double>")
    known = vectored.orderBy("h", "lang", F.xxhash64("at"), F.xxhash64("x")).limit(max_train).toPandas()
    names = sorted(set(known["lang"]))
    if not names:
        return [], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0
    classes = known["lang"].map({x: i for i, x in enumerate(names)}).to_numpy()
    features = [(np.asarray(a, dtype=np.int64), np.asarray(x, dtype=np.float64)) for a, x in zip(known["at"], known["x"], strict=True)]
    aside = np.arange(len(features)) % 10 == 9
    w = ftrl([f for f, out in zip(features, aside, strict=True) if not out], classes[~aside], len(names), buckets)
    heat = 1.0
    if aside.any():
        logits = np.array([(x * SCALE) @ w[a] + w[-1] for (a, x), out in zip(features, aside, strict=True) if out])
        heat = temperature(logits, classes[aside])
    return names, (w[:-1] * idf[:, None] * SCALE).astype(np.float32), w[-1], heat


def identify_languages(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, max_train))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = unkeyed(texts.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
