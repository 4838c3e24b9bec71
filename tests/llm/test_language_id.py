"""N-grams of code points in any script, and the bound of the training sample."""

import numpy as np
import pyarrow as pa

from meterlark.llm import language_id as m


def test_grams_are_of_code_points():
    texts = ["Été À", "", "日本語の文", "ПРИВЕТ мир", "a\U0001f600b", "ÀÉ"]
    for first, orders in m.document_grams(pa.array(texts), 1 << 15):
        for (grams, a, b), k in zip(orders, m.ORDERS, strict=True):
            for i, text in enumerate(texts[first:]):
                points = np.array([ord(c) for c in text.lower()], dtype=np.uint64)
                assert grams[a[i] : b[i]].tolist() == m.gram_buckets(points, k, 1 << 15).tolist()
    # A pair of characters is one feature wherever it stands, and capitals are small letters.
    idf = np.ones(1 << 15)
    assert set(m.vector("日本", idf)[0]) < set(m.vector("の日本語", idf)[0])
    assert m.vector("ПРИВЕТ", idf)[0].tolist() == m.vector("привет", idf)[0].tolist()


def test_sample_is_bounded_in_rows(spark, monkeypatch):
    rows = [(i % 3 + 1, f"{'le chat' if i % 2 else 'the cat'} {i}", "fr" if i % 2 else "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen, plain = [], m.ftrl
    monkeypatch.setattr(m, "ftrl", lambda rows, *more: seen.append(len(rows)) or plain(rows, *more))
    names, *_ = m.train(docs, max_train=10)
    assert names and seen == [9]  # a tenth is left out


def test_accuracy_on_held_out_documents(spark):
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.select("doc_id", "lang", "text").collect()}
    found = {r["doc_id"]: r for r in m.identify_languages(docs).collect()}
    assert len(found) == len(truth)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in found.items() if r["held_out"]} == set(held)
    plain = [i for i in held if truth[i][0] is not None and any(c.isalpha() for c in truth[i][1] or "")]
    right = [i for i in plain if found[i]["lang_pred"] == truth[i][0]]
    assert len(plain) > 100 and len(right) >= 0.97 * len(plain)
    # Calibration: the mean score is near the share that is right.
    assert abs(np.mean([found[i]["score"] for i in plain]) - len(right) / len(plain)) < 0.05
    assert all(0 <= r["score"] <= 1 for r in found.values())

