"""Benchmark decontamination by winnowing, in DataFrame code only.

Both sides are cut into lower-cased words and hashed k-grams. Winnowing keeps the smallest k-gram hash of
each run of `window - k + 1` consecutive k-grams, so two texts that share `window` words in a row share a
kept fingerprint. Documents and items that share one are candidates; hits are then extended and confirmed
on the words themselves: a document word counts as hit when it lies inside an occurrence of a full window
of the benchmark item.

Items shorter than a window are one window of their own length. They are found by an exact hash of that
many words, one more hash per document word for each such length (at most window - 1 lengths exist).

Defined results: null or wordless texts have no words, hence no hits and are not contaminated; null or
wordless items have no windows; an empty benchmark leaves every document clean; rows that repeat a doc_id
are one document to the join (their hits are united) and each comes out; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.llm.common import cut, keyed, lower_ascii, unkeyed

WINDOW, GRAM = 13, 5
#: Fingerprints and windows of the benchmark are broadcast up to this many rows and joined by shuffle beyond it.
BROADCAST_ROWS = 200_000
#: Everything that is not a letter, a digit or a non-ASCII character, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


# Arrays are unnested by explode_outer throughout: explode adds a filter on the size of the array that is
# pushed below the projections that build it, where each lambda would evaluate the inner array once more
# for each element.


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), SEPARATORS), lambda w: w != F.lit(""))


def grams(column: str, k: int) -> Column:
    """64-bit hashes of all runs of k words; empty when there are fewer words."""
    return F.expr(f"CASE WHEN size({column}) >= {k} THEN transform(sequence(1, size({column}) - {k - 1}), i -> xxhash64(slice({column}, i, {k}))) ELSE array() END")


def winnowed(hashes: str, width: int) -> Column:
    """The distinct minima of all runs of width hashes."""
    return F.expr(
        f"CASE WHEN size({hashes}) >= {width} THEN array_distinct(transform(sequence(1, size({hashes}) - {width - 1}), i -> array_min(slice({hashes}, i, {width})))) ELSE array() END"
    )


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, length, run): the distinct windows of each item as arrays of words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w")).where("size(w) > 0")
    runs = F.expr(f"CASE WHEN size(w) < {window} THEN array(w) ELSE transform(sequence(1, size(w) - {window - 1}), i -> slice(w, i, {window})) END")
    return items.select("item_id", F.explode_outer(runs).alias("run")).distinct().withColumn("length", F.size("run"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of docs.

    contaminated: share * n_hit >= n_words with at least one hit.
    """
    width = window - gram + 1
    split = keyed(docs).select("doc_id", words(F.col("text")).alias("w"))
    windows = cut(item_windows(benchmark, window), "benchmark-windows")
    short = [r[0] for r in windows.where(F.col("length") < window).select("length").distinct().collect()]  # under window values

    marks = windows.where(F.col("length") == window).select(F.explode_outer(winnowed_of_run(gram)).alias("mark")).distinct()
    for n in short:
        marks = marks.unionByName(windows.where(F.col("length") == n).select(F.xxhash64(F.lit(n), "run").alias("mark")).distinct())
    marks = bounded(cut(marks, "benchmark-fingerprints"))

    hashed = split.withColumn("h", grams("w", gram))
    # A document of fewer words than a window cannot hold one, but it can hold a short item.
    kept = winnowed("h", width)
    for n in short:
        kept = F.concat(kept, F.expr(f"CASE WHEN size(w) >= {n} THEN transform(sequence(1, size(w) - {n - 1}), i -> xxhash64({n}, slice(w, i, {n}))) ELSE array() END"))
    measured = hashed.select("doc_id", F.size("w").cast("long").alias("n_words"), "w", kept.alias("marks"))
    candidates = measured.select("doc_id", F.explode_outer("marks").alias("mark")).join(marks, "mark", "left_semi").select("doc_id").distinct()
    candidates = cut(candidates, "candidates")

    # Extension on the words themselves, for candidate documents only.
    lengths = sorted({window, *short})
    positions = F.flatten(
        F.array(*[F.expr(f"CASE WHEN size(w) >= {n} THEN transform(sequence(1, size(w) - {n - 1}), i -> struct(i AS at, slice(w, i, {n}) AS run)) ELSE array() END") for n in lengths])
    )
    near = split.join(bounded(candidates), "doc_id", "left_semi").select("doc_id", F.explode_outer(positions).alias("p")).select("doc_id", "p.at", F.col("p.run").alias("run"))
    hits = near.join(bounded(windows.select("run", "length", "item_id")), "run").select("doc_id", "at", "length", "item_id")
    # A word is covered once however many windows hold it: a window adds what lies beyond the furthest end so far.
    per_doc = hits.groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct("at", F.expr("at + length").alias("end")))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    covered = F.expr("aggregate(spans, struct(0L AS n, 0 AS upto), (a, s) -> struct(a.n + greatest(0, s.end - greatest(s.at, a.upto)) AS n, greatest(a.upto, s.end) AS upto), a -> a.n)")
    found = cut(per_doc.select("doc_id", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "contaminated")
    sizes = split.select("doc_id", F.size("w").cast("long").alias("n_words"))
    out = sizes.join(bounded(found), "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
    )
    return unkeyed(out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))))


def winnowed_of_run(gram: int) -> Column:
    """The one fingerprint of a full window, as an array."""
    return F.expr(f"array(array_min(transform(sequence(1, size(run) - {gram - 1}), i -> xxhash64(slice(run, i, {gram})))))")
