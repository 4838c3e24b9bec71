"""The extendible-hash index: directory, collisions and hot contents."""

from collections import defaultdict

from pyspark.sql import functions as F

from meterlark.llm.exact_dedup import directory, exact_dedup


def _expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups["".join(c.lower() if c.isascii() else c for c in text or "")].append(doc_id)
    return sorted((d, max(g), len(g), d == max(g)) for g in groups.values() for d in g)


def test_collisions_are_told_apart(spark):
    rows = [(i, ("Same" if i % 3 else "same") if i % 2 else f"text {i % 7}") for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for key, digest in ((F.xxhash64, None), (lambda c: F.length(c).cast("long"), None), (lambda c: F.lit(5).cast("long"), lambda c: F.lit("x"))):
        found = exact_dedup(docs, bucket_keys=2, key=key, digest=digest).collect()
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found) == _expected(rows)


def test_directory_splits_overfull_buckets_only(spark):
    # 300 keys under one leading byte, 3 elsewhere.
    keys = spark.createDataFrame([((1 << 56) + (i << 46),) for i in range(300)] + [(-1,), (-2,), (1 << 62,)], "key long")
    depth, table = directory(spark, keys, bucket_keys=100)
    slots = table.collect()
    assert len(slots) == 1 << depth and depth > 7
    assert min(r["depth"] for r in slots) == 1  # the other half of the hash range is one bucket
    counted = keys.withColumn("slot", F.shiftrightunsigned("key", 64 - depth)).join(table, "slot").groupBy("bucket").count().collect()
    assert sum(r["count"] for r in counted) == 303 and max(r["count"] for r in counted) <= 100
