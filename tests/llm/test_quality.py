"""The quality model against n-grams counted one by one, over more of them than any fixed table would tell apart."""

import random
from collections import Counter

import numpy as np
import pyarrow.compute  # noqa: F401
import pytest

from meterlark.llm import quality as m


def test_more_rows_than_a_sort_key_holds():
    import pyarrow as pa

    texts = [f"w{i} same w{i}" for i in range(3 * m.KEY_ROWS)]
    rows = {first + i: at[i + 1] - at[i] for first, _, at in m.ngrams(pa.array(texts)) for i in range(len(at) - 1)}
    assert len(rows) == len(texts) and set(rows.values()) == {4}


def test_weights_equal_exact_counts(spark):
    rng, n = random.Random(5), 500
    noise = iter(range(10**9))
    texts = []
    for i in range(n):
        words = [f"u{next(noise)}" for _ in range(300)] + rng.choices(["the", "of", "and"], k=20)
        rng.shuffle(words)
        texts.append(" ".join(["fine honest prose" if i % 2 else "cheap pills online", *words]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")

    grams = []
    for t in texts:
        w = t.split()
        grams.append([set(w), {p if p[0] != p[1] else "same" for p in zip(w, w[1:])}])
    expected = np.zeros(n)
    for kind in (0, 1):
        raw = Counter(g for x in grams for g in x[kind])
        target = Counter(g for i in range(1, 200, 2) for g in grams[i][kind])
        a, b = np.array(list(raw.values())), np.array([target[g] for g in raw])
        ratio = dict(zip(raw, m.log_ratios(a, b, m.raw_scale(a, b)), strict=True))
        expected += [sum(ratio[g] for g in x[kind]) for x in grams]
    expected /= [np.sqrt(len(a) + len(b)) for a, b in grams]
    found = {r["doc_id"]: r["log_weight"] for r in m.quality(docs, labels).collect()}
    assert [found[i] for i in range(n)] == pytest.approx(list(expected), abs=2e-6)
    assert found[1] > 0 > found[0]


@pytest.mark.parametrize("temperature", [m.TEMPERATURE, 0.5])
def test_kept_is_the_top_k_of_a_full_sort(spark, temperature):
    """The threshold by trying every cut, k by counting, the draw by sorting all keys; equal weights and unlabelled rows among them."""
    import math

    from pyspark.sql import functions as F

    rng = random.Random(8)
    texts = []
    for i in range(900):
        words = rng.choices(["honest", "prose", "reads", "well", "here"] if i % 3 else ["cheap", "pills", "online", "now", "well"], k=rng.randrange(4, 30))
        texts.append(" ".join(words))
    texts += texts[:60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0) if i % 11 else int(i % 3 == 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in m.quality(docs, labels, temperature=temperature).collect()}

    known = [(rows[i]["log_weight"], i % 3 > 0 if i % 11 else i % 3 == 0) for i in range(300)]
    weights = sorted({w for w, _ in known})
    cuts = [-math.inf, *((a + b) / 2 for a, b in zip(weights, weights[1:])), weights[-1] + 1e-6]
    good, bad = sum(g for _, g in known), sum(not g for _, g in known)
    balance = lambda c: sum(g and w >= c for w, g in known) / good + sum(not g and w < c for w, g in known) / bad
    threshold = max(cuts, key=balance)
    k = sum(r["log_weight"] >= threshold for r in rows.values())
    assert 0 < k < len(rows)
    bits = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(0)).alias("h")).collect()}
    noise = {i: -math.log(-math.log(((h % 2**64 >> 12) + 0.5) / 2.0**52)) for i, h in bits.items()}
    ranked = sorted(rows, key=lambda i: rows[i]["log_weight"] / temperature + noise[i], reverse=True)
    assert {i for i, r in rows.items() if r["kept"]} == set(ranked[:k])
    hard = {i for i, r in rows.items() if r["log_weight"] >= threshold}
    assert (hard == set(ranked[:k])) == (temperature < 0.1) or len(hard ^ set(ranked[:k])) < 0.1 * k


def _counted(batches):
    return [Counter(dict(zip(np.cumsum(m._whole(g)).tolist(), m._whole(c).tolist(), strict=True))) for b in batches for g, c in zip(b.column("grams").to_pylist(), b.column("counts").to_pylist(), strict=True)]


def test_counting_takes_little_more_than_its_sums():
    """Two of these tasks share an executor with its heap: a task may hold its sums, but no sort or copy that is many times larger."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 300))) for _ in range(2_500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([i % 2 == 0 for i in range(len(texts))])], names=["doc_id", "text", "good"])
    tracemalloc.start()
    try:
        for _ in m._count(6)(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 70e6


def test_sums_handed_on_in_parts_are_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(m, "HELD", 500)
    monkeypatch.setattr(m, "WAITING", 64)
    monkeypatch.setattr(m, "TEXT_BYTES", 500)
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(900)], k=rng.randrange(40))) for _ in range(120)]
    good = [i % 3 == 0 for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(good)], names=["doc_id", "text", "good"])
    parts = list(m._count(6)(iter([batch])))
    expected = {True: Counter(), False: Counter()}
    for first, grams, at in m.ngrams(batch.column(1)):
        for i in range(len(at) - 1):
            own = Counter(grams[at[i] : at[i + 1]].tolist())
            expected[False] += own
            expected[True] += own if good[first + i] else Counter()
    for target in (False, True):
        own = [b.filter(pa.compute.equal(b.column("target"), target)) for b in parts]
        assert sum(_counted(own), Counter()) == expected[target]
    assert len([b for b in parts if b.num_rows]) > 8
    rows = pa.Table.from_batches(parts)
    for key in set(rows["slice"].to_pylist()):
        own = rows.filter(pa.compute.equal(rows["slice"], key))
        (found,) = m._add_slices(1)((key,), iter(own.to_batches(max_chunksize=3)))
        assert dict(zip(*(found.column(x).to_pylist() for x in ("gram", "raw")), strict=True)) == {g: n for g, n in expected[False].items() if g >> (m.GRAM_BITS - 6) == key}
        assert all(t == expected[True][g] for g, t in zip(*(found.column(x).to_pylist() for x in ("gram", "target")), strict=True))
