"""Near-duplicate groups by fast similarity sketching.

A document is the set of its hashed word shingles. The sketch has `bands * rows` coordinates. In round i each
element is placed in one hashed bin with a hashed value; a coordinate keeps the value of the first round that
reached it, the smallest of that round. After as many such rounds as there are coordinates, round t + j places
every element in bin j, so that every coordinate fills; sets of t log t elements need about one round. Runs of
`rows` coordinates make the bands.

1. Documents with the same set are one class, represented by the smallest doc_id (folded map-side).
2. In each band bucket every class is paired with one centre alone (a star, never all pairs). The centre is the
   class that meets most others in its bands: what near copies were made from is closer to each of them than
   they are to each other. Pairs are confirmed on the full sets; connected components follow.
3. A link that no star shows lies inside a bucket that still spans several components: there all members of
   different components are compared, so no candidate is left out. The members of a bucket are packed into blocks
   of about `BLOCK`, and each pair of blocks is compared by one numpy step, so that what Spark joins and shuffles
   is blocks and the few pairs that are left.

Before a pair leaves such a comparison it must pass a bound that loses no link: each set has a parity sketch of
1024 bits, and two sketches differ in no more bits than the sets in elements. Joins on a bucket, hub or class that
many rows share carry ids and counts alone and are left to the skew handling of adaptive execution.

At a similarity of 0.8 a pair shares none of 40 bands of 6 rows with probability 5e-6.

Defined results: a text of fewer words than a shingle is one shingle of all its words; null, empty or wordless
texts have an empty set and are linked with nothing; rows that share a doc_id are one document whose links are
united, each comes out; an empty table gives an empty result; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.llm.common import NO_ID, cut, gram_hashes, keyed, mix, ranges_hash, release, salt, seeded, text_chunks, unkeyed, word_hashes

BANDS, ROWS, PERCENT = 40, 6, 80
#: Members of a block, about.
BLOCK = 512
_U = np.uint64
_ROUND_SEEDS = seeded(77, 4096)
_PARITY_SEED = seeded(78, 1)[0]


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offs in text_chunks(column):
        words, at = word_hashes(data, offs, lower=True)
        grams = gram_hashes(words, size)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                whole = np.array([b - a], dtype=np.int64)
                yield ranges_hash(words[a:b], np.zeros(1, np.int64), whole, 0x2545F4914F6CDD1D)
            else:
                yield np.zeros(0, dtype=_U)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of a non-empty set: the round in the high bits, the value in the low ones."""
    n, out, filled, done = len(elements), np.zeros(t, dtype=_U), np.zeros(t, dtype=bool), 0
    while done < t and not filled.all():
        rounds = min(t - done, max(1, int(1.25 * t * np.log(t + 1) / n)))
        h = mix(elements[None, :] ^ _ROUND_SEEDS[done : done + rounds, None])
        bins = ((h >> _U(40)) % _U(t)).astype(np.int64).ravel()
        keys = ((np.arange(done, done + rounds, dtype=_U)[:, None] << _U(50)) | (mix(h) >> _U(14))).ravel()
        order = np.argsort(keys)[::-1]
        found = np.zeros(t, dtype=_U)
        found[bins[order]] = keys[order]  # the smallest is written last
        hit = np.zeros(t, dtype=bool)
        hit[bins] = True
        new = hit & ~filled
        out[new] = found[new]
        filled |= hit
        done += rounds
    for j in np.flatnonzero(~filled).tolist():
        values = mix(mix(elements ^ _ROUND_SEEDS[t + j])) >> _U(14)
        out[j] = (_U(t + j) << _U(50)) | values.min()
    return out


def parity_bits(elements: np.ndarray) -> np.ndarray:
    """1024 bits, each the parity of the elements hashed there, as 16 words."""
    odd = np.bincount((mix(elements ^ _PARITY_SEED) >> _U(54)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = seeded(5, bands)
    grid = coordinates.reshape(bands, rows)
    for i in range(rows):
        out = mix(out ^ grid[:, i]) + _U(0x9E3779B97F4A7C15)
    return out.view(np.int64)


def _sketches(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, first, second, keys, bits = [], [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                counts.append(len(s))
                with np.errstate(over="ignore"):
                    first.append(int(s.sum(dtype=_U)) if len(s) else 0)
                    second.append(int(mix(s ^ _U(0xC2B2AE3D27D4EB4F)).sum(dtype=_U)) if len(s) else 0)
                keys.append(band_keys(sketch(s, bands * rows), bands, rows) if len(s) else np.zeros(0, np.int64))
                bits.append(parity_bits(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(np.array(first, _U).view(np.int64)), pa.array(np.array(second, _U).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                names=["doc_id", "n", "a", "b", "bands", "bits"],
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                sets = [s.view(np.int64) for s in shingle_sets(part.column(1), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "elements"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (x, y) whose full sets have percent * union <= 100 * intersection; y may be the centre of many."""
    salted = pairs.withColumn("salt", salt("x"))
    left = sets.select(F.col("id").alias("x"), F.col("elements").alias("xs"))
    right = salted.select("y", "salt").distinct().join(sets.select(F.col("id").alias("y"), F.col("elements").alias("ys")), "y")
    both = salted.join(left, "x").join(right, ["y", "salt"])
    common = F.size(F.array_intersect("xs", "ys"))
    return both.select("x", "y", common.alias("i"), (F.size("xs") + F.size("ys") - common).alias("u")).where(100 * F.col("i") >= percent * F.col("u")).select("x", "y")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of a link (x, y) reaches; alternating large and small stars."""
    edges = cut(links.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "links")

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())

    now = mark(edges)
    while now[0]:
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        # Large star: larger neighbours of u go to the smallest neighbour of u, or to u.
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # Small star: smaller neighbours of u, and u, go to the smallest of them.
        lowest = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(lowest, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        edges, old = cut(small.union(lowest.select("x", F.col("m").alias("y"))).where("x <> y").distinct(), "links"), edges
        release(old)
        before, now = now, mark(edges)
        if now == before:
            break
    return edges.groupBy("x").agg(F.min("y").alias("component")).withColumnRenamed("x", "id")


def _may_link(percent: int):
    """Whether (n, bits) and (yn, ybits) may be similar enough, by sizes and by the parity bound."""
    differing = F.lit(0)
    for i in range(16):
        differing = differing + F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("ybits")[i]))
    return (100 * F.least("n", "yn") >= percent * F.greatest("n", "yn")) & ((100 + percent) * differing <= (100 - percent) * (F.col("n") + F.col("yn")))


def _ordered_pairs(met: DataFrame) -> DataFrame:
    return met.select(F.greatest("id", "y").alias("x"), F.least("id", "y").alias("y")).distinct()


def _star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of each member with the centre of its band: the member of largest degree, the smallest id on a tie."""
    centres = members.groupBy("band").agg(F.max_by(F.struct(F.col("id").alias("y"), F.col("n").alias("yn"), F.col("bits").alias("ybits")), F.struct(F.col("degree"), -F.col("id"))).alias("c")).select("band", "c.*")
    return _ordered_pairs(members.join(centres, "band").where(F.col("id") != F.col("y")).where(_may_link(percent)))


def _compare(percent: int):
    """Pairs (x, y) of two blocks that are of different components and may be similar enough."""

    def members(row: list[dict]) -> tuple[np.ndarray, ...]:
        ids, n, component = (np.array([m[c] for m in row], dtype=np.int64) for c in ("id", "n", "component"))
        return ids, n, component, np.array([m["bits"] for m in row], dtype=np.int64).view(_U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, n, of, bits), (yids, yn, yof, ybits) = (members(batch.column(c)[i].as_py()) for c in ("left", "right"))
                found = [np.zeros((2, 0), np.int64)]
                for a in range(0, len(ids), 64):  # some megabytes at a time
                    both = n[a : a + 64, None] + yn[None, :]
                    fits = (of[a : a + 64, None] != yof[None, :]) & (100 * np.minimum(n[a : a + 64, None], yn[None, :]) >= percent * np.maximum(n[a : a + 64, None], yn[None, :]))
                    differing = np.bitwise_count(bits[a : a + 64, None, :] ^ ybits[None, :, :]).sum(axis=2, dtype=np.int64)
                    x, y = np.nonzero(fits & ((100 + percent) * differing <= (100 - percent) * both))
                    found.append(np.stack((ids[a + x], yids[y])))
                pairs = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=0)), pa.array(pairs.min(axis=0))], names=["x", "y"])

    return run


def _open_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of members of a band that are of different components, block by block."""
    sizes = members.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    placed = members.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("k")).cast("int"))
    blocks = placed.groupBy("band", "k", "block").agg(F.collect_list(F.struct("id", "n", "component", "bits")).alias("members"))
    left = blocks.select("band", F.explode(F.sequence(F.col("block"), (F.col("k") - 1).cast("int"))).alias("block"), F.col("members").alias("left"))
    met = left.join(blocks.select("band", "block", F.col("members").alias("right")), ["band", "block"])
    return met.select("left", "right").mapInArrow(_compare(percent), "x long, y long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    texts = keyed(docs)
    sketched = cut(texts.mapInArrow(_sketches(shingle, bands, rows), "doc_id long, n long, a long, b long, bands array<long>, bits array<long>"), "sketches")
    # Copies of a set fold before the shuffle; bands are equal within a class.
    classes = cut(
        sketched.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("id"), F.min("bands").alias("bands"), F.min("bits").alias("bits")),
        "classes",
    )
    placed = classes.select("id", "n", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    met = cut(placed.join(shared, "band"), "met")
    # How many others a class meets in all its bands.
    degrees = met.groupBy("id").agg(F.sum("members").alias("degree")).join(classes.select("id", "bits"), "id")
    members = cut(met.drop("members").join(degrees, "id"), "members")
    release(met)

    # The sets of all that meet another, read once for both rounds.
    wanted = members.select("id").distinct()
    sets = cut(texts.join(wanted, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(_sets(shingle), "id long, elements array<long>").dropDuplicates(["id", "elements"]), "sets")
    pairs = cut(_star_pairs(members, percent), "star-pairs")
    links = cut(confirmed(pairs, sets, percent), "confirmed")
    grouped = cut(components(links), "components")
    # Buckets that still span several components.
    labelled = members.drop("degree").join(grouped, "id", "left").withColumn("component", F.coalesce("component", "id"))
    still = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    opened = cut(labelled.join(still, "band"), "open-buckets")
    more = cut(_open_pairs(opened, percent).join(pairs, ["x", "y"], "left_anti"), "open-pairs")
    release(opened, members)
    if not more.isEmpty():
        grouped = components(links.union(cut(confirmed(more, sets, percent), "confirmed")))
    release(sets)

    of_class = classes.select("n", "a", "b", "id").join(grouped, "id", "left").select("n", "a", "b", F.coalesce("component", "id").alias("component_id"))
    # Given out by salt, so that the copies of a hot set are spread over tasks; empty sets belong to no class.
    members = sketched.select("doc_id", "n", "a", "b", salt().alias("salt"))
    salts = members.where("n > 0").select("n", "a", "b", "salt").distinct()
    given = salts.join(of_class, ["n", "a", "b"])
    placed_rows = members.where("n > 0").join(given, ["n", "a", "b", "salt"]).select("doc_id", "n", "component_id")
    found = placed_rows.unionByName(members.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    out = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return unkeyed(out).withColumn("component_id", F.nullif("component_id", F.lit(NO_ID)))
