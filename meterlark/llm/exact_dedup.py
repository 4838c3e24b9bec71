"""Exact deduplication by an extendible-hash index in shared files.

1. Contents. Texts fold map-side to one row for each distinct content: their bytes are the grouping key, so
   copies are compared byte by byte, and a content that a third of all rows share is a row for each task. What
   is left of a content is (64-bit key, length, SHA-256), the row that stays and the number of copies.
2. Directory. Over the leading bits of the key it doubles until no bucket holds more contents than
   `bucket_keys`; buckets that did not overfill keep their smaller local depth. It has at most 2**MAX_DEPTH
   slots whatever the input (some 20 MB), so it can be broadcast.
3. Index. Each content finds its bucket through the directory and is dealt to the owner of the bucket's key
   range. The owner chains contents whose keys collide: the place in the chain tells apart even contents of
   the same key, length and SHA-256. The index is a table in the shared folder, in bucket order.
4. Lookup. Each document finds its bucket through the directory and its entry in the index by (bucket, key,
   length, SHA-256). Entries are given out by salt, so that copies of a hot content are spread over `SALTS`
   tasks; a document brings no text there. Only if a chain holds contents that agree in all three do its
   documents come again with their texts.

Everything is DataFrame code. Defined results: null text counts as empty; an empty table gives an empty
result; rows that repeat a doc_id and text each come out and each count in group_size, and with the largest
doc_id they all stay; a null doc_id sorts below every other; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlark.llm.common import cut, keyed, lower_ascii, salt, unkeyed

#: Contents that a bucket may hold before its directory entry is split.
BUCKET_KEYS = 50_000
MAX_DEPTH = 20
CHAIN = ["bucket", "key", "size", "text_sha256"]


def directory(spark: SparkSession, keys: DataFrame, bucket_keys: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH) -> tuple[int, DataFrame]:
    """The global depth, and (slot, depth, bucket) for each of its 2**depth slots.

    Counts at the deepest level are taken once; a bucket is the shallowest prefix that holds at most
    bucket_keys keys. The table has at most 2**max_depth rows whatever the input.
    """
    deepest = cut(keys.groupBy(F.shiftrightunsigned("key", 64 - max_depth).alias("slot")).agg(F.count("*").alias("n")), "directory-counts")
    # Doubling: one more leading bit as long as some bucket of the present depth is overfull.
    levels = [F.shiftrightunsigned("slot", max_depth - d).alias("prefix") for d in range(max_depth + 1)]
    depth = 0
    while depth < max_depth and (deepest.groupBy(levels[depth]).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) > bucket_keys:
        depth += 1
    counts = None
    for d in range(depth + 1):
        level = deepest.groupBy(levels[d]).agg(F.sum("n").alias("n")).select(F.lit(d).alias("depth"), "prefix", "n")
        counts = level if counts is None else counts.unionByName(level)
    fits = counts.where((F.col("n") <= bucket_keys) | (F.col("depth") == depth))
    slots = spark.range(1 << depth).select(F.col("id").alias("slot"))
    # Each slot takes the shallowest prefix of its own that fits.
    each = slots.select("slot", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth")).withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {depth} - depth)"))
    found = each.join(fits, ["depth", "prefix"]).groupBy("slot").agg(F.min("depth").alias("depth"))
    table = (
        slots.join(found, "slot", "left")
        .withColumn("depth", F.coalesce("depth", F.lit(depth)))
        .withColumn("bucket", F.expr(f"shiftleft(shiftrightunsigned(slot, {depth} - depth), {depth} - depth)"))
    )
    return depth, cut(table, "dedup-directory")


def exact_dedup(docs: DataFrame, bucket_keys: int = BUCKET_KEYS, key: Callable[[str], Column] = F.xxhash64, digest: Callable[[str], Column] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket: one row for each row of docs.

    key and digest are the hash functions of the index; weaker ones make more collisions and no other result,
    except that text_sha256 is what digest gives.
    """
    spark = docs.sparkSession
    digest = digest or (lambda column: F.sha2(column, 256))
    texts = keyed(docs).select("doc_id", lower_ascii(F.col("text")).alias("text"))
    measures = {"key": key("text"), "size": F.octet_length("text").cast("long"), "text_sha256": digest("text")}

    folded = texts.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    contents = cut(folded.select(*(c.alias(n) for n, c in measures.items()), "keep_id", "group_size"), "dedup-contents")
    depth, table = directory(spark, contents.select("key"), bucket_keys)

    def bucketed(df: DataFrame) -> DataFrame:
        slot = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
        # At most 2**MAX_DEPTH rows.
        return df.withColumn("slot", slot).join(F.broadcast(table.select("slot", "bucket")), "slot").drop("slot")

    # keep_id orders a chain: two contents have different rows that stay, or else the same repeated doc_id.
    place = F.row_number().over(Window.partitionBy(*CHAIN).orderBy("keep_id", "group_size"))
    owned = bucketed(contents).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    index = cut(owned.withColumn("place", place), "dedup-index")

    entries = cut(bucketed(texts.select("doc_id", *(c.alias(n) for n, c in measures.items()))).withColumn("salt", salt()), "dedup-entries")
    salts = entries.groupBy(*CHAIN, "salt").agg(F.count("*").alias("rows"))
    given = salts.join(index.where("place = 1").select(*CHAIN, "keep_id", "group_size"), CHAIN).drop("rows")
    found = entries.join(given, [*CHAIN, "salt"])

    forks = index.where("place > 1").select("key", "size", "text_sha256").distinct()
    if not forks.isEmpty():  # contents of the same key, length and digest: their documents are told apart by the bytes
        forked = cut(texts.select("doc_id", "text", *(c.alias(n) for n, c in measures.items())).join(forks, ["key", "size", "text_sha256"], "left_semi"), "dedup-forks")
        parts = forked.withColumn("salt", salt()).groupBy("text", "salt").agg(F.max("doc_id").alias("last"), F.count("*").alias("n"))
        heads = parts.groupBy("text").agg(F.max("last").alias("keep_id"), F.sum("n").alias("group_size"))
        given = parts.select("text", "salt").join(heads, "text")
        apart = bucketed(forked.withColumn("salt", salt()).join(given, ["text", "salt"]))
        found = found.join(forks, ["key", "size", "text_sha256"], "left_anti").select("doc_id", "keep_id", "group_size", "text_sha256", "bucket").unionByName(apart.select("doc_id", "keep_id", "group_size", "text_sha256", "bucket"))

    out = found.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256", "bucket")
    return unkeyed(out).withColumn("keep_id", F.nullif("keep_id", F.lit(-(2**63))))
