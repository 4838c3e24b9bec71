"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, asymmetric distances, exact rerank.

Vectors are linked whose cosine is at least `threshold`: on the unit sphere, whose distance is at most the chord
C = sqrt(2 - 2 * threshold).

1. Fit. Coarse centres, and beyond `FINE` lists a second set of centres for what the first leaves, so that lists keep
   about `list_size` members up to FINE**2 of them; then a codebook for each part of the residuals. All of it is fitted
   on at most `MAX_TRAIN` rows (and `MAX_TRAIN_VALUES` numbers), chosen by a hash, and is what tasks are sent:
   at most 2 * FINE + 256 vectors, whatever the input.
2. Balls. Vectors of one list that lie within C / 2 of a common centre are linked to each other, without a comparison
   of each two of them. Each task folds its rows into such balls before anything is shuffled, and lists that still
   hold many balls fold again, by parts, until that helps no more: a group of near copies becomes a few balls
   (centre, radius, number), however large it is. Most balls hold one vector. A centre is kept in 8 bits a number, and
   what that rounds away is part of the radius.
3. Search. Each ball has a residual code in its own list and visits the `probes` nearest lists. The distance of a
   visitor to a coded centre is summed from tables; by the triangle inequality no ball within reach is missed in a list
   that is visited: a pair goes on if the table distance is at most C + both radii + the code's error. What lists miss
   is what the index loses (see the tests for the recall). Large lists are cut into blocks on both sides.
4. Rerank. From the centres a pair of balls is linked as a whole, not at all, or mixed. The members of mixed pairs are
   fetched from the table and compared by their cosines in double precision, chunk by chunk in numpy; what leaves such
   a comparison is a count for each member, never the pairs.

A row's links are the other members of its ball, the members of balls linked as a whole, and its counts; components
are those of the balls.

Defined results: vectors that are null, zero, hold null or non-finite numbers, or are of another length than most (of
equally frequent lengths the larger counts) link with nothing; rows that share an id are vectors of their own; a null
id sorts below every other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.llm.common import cut, owner_cuts
from meterlark.llm.minhash import components

THRESHOLD, PROBES, LIST_SIZE = 0.9, 8, 512
#: Rows and numbers that the index is fitted on, at most.
MAX_TRAIN, MAX_TRAIN_VALUES = 16_384, 1 << 21
#: Centres of a level, at most, and the parts and entries of the residual codes.
FINE, PARTS, ENTRIES = 1024, 16, 256
#: Rows that a task folds into balls together, and those compared each with each.
FOLDED, SQUARE = 8192, 2048
#: Balls of a list, and visitors to it, that meet in one group.
BLOCK, VISITORS = 2048, 8192
#: Balls of a list beyond which they fold again.
MANY = 4096
#: Members of a ball that are compared together.
CHUNK = 256
#: What rounding may add to a distance.
SLACK = 1e-6

_PLACED = "uid long, vec_id long, content long, ball long, n long, r double, scale double, centre binary, list int, visits binary, code binary, err double"


def chord(threshold: float) -> float:
    return float(np.sqrt(2 - 2 * threshold))


# --- fit ----------------------------------------------------------------------------------------------------


def centres(points: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k means of points; a centre that no point is nearest to stays where it is."""
    k = max(1, min(k, len(points)))
    out = points[np.random.default_rng(seed).choice(len(points), k, replace=False)].copy()
    for _ in range(rounds if k > 1 else 1):
        near = nearest(points, out)
        order = np.argsort(near, kind="stable")
        for a, b in zip(*owner_cuts(near[order]), strict=True):
            out[near[order[a]]] = points[order[a:b]].mean(axis=0)
    return out


def nearest(points: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(axis=1)
    return np.concatenate([(points[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(points), 4096)] or [np.zeros(0, np.int64)])


class Index:
    """Coarse centres and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, probes: int):
        self.dim, self.probes = sample.shape[1], probes
        self.parts = min(PARTS, self.dim)
        self.width = -(-self.dim // self.parts)
        sample = sample.astype(np.float32)
        self.first = centres(sample, min(lists, FINE))
        left = sample - self.first[nearest(sample, self.first)]
        more = min(FINE, -(-lists // FINE))
        self.second = centres(left, more) if more > 1 else np.zeros((1, self.dim), np.float32)
        left = self.split(sample - self.centre(self.own(sample)))
        self.books = [centres(np.ascontiguousarray(left[:, m]), ENTRIES, 6) for m in range(self.parts)]

    def split(self, x: np.ndarray) -> np.ndarray:
        """Rows by part, filled up with zeros."""
        out = np.zeros((len(x), self.parts * self.width), np.float32)
        out[:, : self.dim] = x
        return out.reshape(len(x), self.parts, self.width)

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.first[lists // len(self.second)] + self.second[lists % len(self.second)]

    def own(self, x: np.ndarray) -> np.ndarray:
        return self.visits(x, 1)[:, 0]

    def visits(self, x: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The nearest lists of each row, the nearest first."""
        x, probes = x.astype(np.float32), probes or self.probes
        out = []
        for i in range(0, len(x), 256):
            rows = x[i : i + 256]
            score = rows @ self.first.T - 0.5 * (self.first * self.first).sum(axis=1)
            beam = _largest(score, min(score.shape[1], max(probes, 8)))
            if len(self.second) == 1:
                out.append(beam[:, :probes])
                continue
            both = self.first[:, None, :] if len(self.first) * len(self.second) <= 1 << 14 else None
            cross = self.first @ self.second.T if both is None else (both * self.second[None]).sum(axis=2)
            fine = np.take_along_axis(score, beam, 1)[:, :, None] + (rows @ self.second.T - 0.5 * (self.second * self.second).sum(axis=1))[:, None, :] - cross[beam]
            flat = _largest(fine.reshape(len(rows), -1), min(probes, beam.shape[1] * len(self.second)))
            out.append(np.take_along_axis(beam, flat // len(self.second), 1) * len(self.second) + flat % len(self.second))
        return np.concatenate(out) if out else np.zeros((0, probes), np.int64)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes, and how far each coded row is from the row."""
        left = self.split(x - self.centre(lists))
        code = np.stack([nearest(np.ascontiguousarray(left[:, m]), self.books[m]) for m in range(self.parts)], axis=1).astype(np.uint8)
        told = np.stack([self.books[m][code[:, m]] for m in range(self.parts)], axis=1)
        return code, np.sqrt(((left - told).astype(np.float64) ** 2).sum(axis=(1, 2)))

    def distances(self, visitors: np.ndarray, at: int, code: np.ndarray) -> np.ndarray:
        """Distance of each visitor to each coded row of list `at`: sums of looked-up squares."""
        left = self.split(visitors - self.centre(np.array([at])))
        total = np.zeros((len(visitors), len(code)), np.float32)
        for m in range(self.parts):
            b = self.books[m]
            table = (left[:, m] ** 2).sum(axis=1)[:, None] - 2 * left[:, m] @ b.T + (b * b).sum(axis=1)
            total += table[:, code[:, m]]
        return np.sqrt(np.maximum(total, 0))


def _largest(score: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k largest values of each row, largest first."""
    top = np.argpartition(score, -k, axis=1)[:, -k:] if k < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)


# --- balls ------------------------------------------------------------------------------------------------------


def in_eight_bits(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale


def balls(x: np.ndarray, r: np.ndarray, n: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fold rows (points, or balls of radius r with n members) into balls of at most `radius`.

    Gives for each row its ball, and each ball's first row, centre and radius. Any two members of a ball are within
    2 * radius of each other.
    """
    m = len(x)
    if m > SQUARE:
        parts = [balls(x[i : i + SQUARE], r[i : i + SQUARE], n[i : i + SQUARE], radius) for i in range(0, m, SQUARE)]
        offsets = np.cumsum([0] + [len(p[1]) for p in parts])
        of = np.concatenate([p[0] + o for p, o in zip(parts, offsets, strict=False)])
        firsts = np.concatenate([p[1] + i for p, i in zip(parts, range(0, m, SQUARE), strict=True)])
        if len(firsts) == m or len(firsts) > SQUARE:
            return of, firsts, np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        again = balls(np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]), np.bincount(of, n).astype(np.int64), radius)
        return again[0][of], firsts[again[1]], again[2], again[3]
    if m == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64), x, r
    size = (x * x).sum(axis=1)
    apart = np.sqrt(np.maximum(size[:, None] + size[None, :] - 2 * x @ x.T, 0)) + SLACK
    np.fill_diagonal(apart, 0)
    reach = apart + r[None, :] <= radius
    np.fill_diagonal(reach, True)
    of = np.full(m, -1, np.int64)
    firsts, middles, radii = [], [], []

    def close(rows: np.ndarray, middle: np.ndarray, wide: float) -> None:
        of[rows] = len(firsts)
        firsts.append(int(rows.min()))
        middles.append(middle)
        radii.append(wide)

    def about(middle: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((x[rows] - middle) ** 2).sum(axis=1)) + r[rows] + SLACK

    waiting = np.argsort(reach @ n, kind="stable").tolist()
    while waiting:
        i = waiting.pop()
        if of[i] >= 0:
            continue
        free = of < 0
        rows, near = np.flatnonzero(reach[i] & free), np.flatnonzero((apart[i] <= 2 * radius) & free)
        if len(near) > 1:
            # What a group was made from is closer to all of it than any of its members.
            mean = (x[near] * n[near, None]).sum(axis=0) / n[near].sum()
            around = about(mean, near)
            if (around <= radius).sum() >= max(2, len(rows)):
                rows = near[around <= radius]
                close(rows, mean, float(around[around <= radius].max()))
                if of[i] < 0:
                    waiting.append(i)
                continue
        if len(rows) == 1:
            close(rows, x[i], float(r[i]))
        else:
            close(rows, x[i], float((apart[i, rows] + r[rows]).max()))
    return of, np.array(firsts), np.stack(middles), np.array(radii)


def _folded(index: Index, x: np.ndarray, r: np.ndarray, n: np.ndarray, lists: np.ndarray, radius: float):
    """balls() within each list: (ball of each row, first rows, centres in 8 bits, scales, radii with what rounding took, numbers)."""
    of = np.zeros(len(x), np.int64)
    firsts, middles, radii, made = [], [], [], 0
    order = np.argsort(lists, kind="stable")
    for a, b in zip(*owner_cuts(lists[order]), strict=True):
        rows = order[a:b]
        ball, first, middle, wide = balls(x[rows], r[rows], n[rows], radius)
        of[rows] = ball + made
        made += len(first)
        firsts.append(rows[first])
        middles.append(middle)
        radii.append(wide)
    middle = np.concatenate(middles)
    small, scale = in_eight_bits(middle)
    lost = np.sqrt(((small * scale[:, None] - middle) ** 2).sum(axis=1))
    return of, np.concatenate(firsts), small, scale, np.concatenate(radii) + lost + SLACK, np.bincount(of, n, made).astype(np.int64)


def _described(index: Index, small: np.ndarray, scale: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lists to visit, codes, their errors) of centres in 8 bits; a ball stays in the list of its members."""
    x = small * scale[:, None]
    return index.visits(x).astype(np.int32), *index.codes(x, lists)


def _binary(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(flat.dtype.itemsize * flat.shape[1]), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width)


def _numbers(batch: pa.RecordBatch, *names: str) -> Iterator[np.ndarray]:
    return (batch.column(c).to_numpy(zero_copy_only=False) for c in names)


def _table(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches, so many at a time."""
    held, size = [], 0
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            held.append(batch.slice(first, rows))
            size += held[-1].num_rows
            if size >= rows:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield from whole.slice(0, rows).to_batches()
                held, size = whole.slice(rows).to_batches(), size - rows
    if size:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def unit(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision of a list column without nulls."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _placed(model, radius: float):
    """Rows of vectors with their lists and balls; a ball's first row describes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value
        for batch in _table(batches, FOLDED):
            x = unit(batch.column("vec"), index.dim)
            lists = index.own(x)
            n = len(x)
            of, firsts, small, scale, wide, sizes = _folded(index, x, np.zeros(n), np.ones(n, np.int64), lists, radius)
            uid = batch.column("uid").to_numpy()
            yield _described_rows(index, batch, uid[firsts][of], firsts, small, scale, wide, sizes, lists)

    return run


def _described_rows(index: Index, batch: pa.RecordBatch, ball, firsts, small, scale, wide, sizes, lists) -> pa.RecordBatch:
    visits, code, err = _described(index, small, scale, lists[firsts])
    where = np.full(batch.num_rows, -1, np.int64)
    where[firsts] = np.arange(len(firsts))
    take = pa.array(where, mask=where < 0)
    spread = lambda a: a.take(take)
    return pa.RecordBatch.from_arrays(
        [batch.column("uid"), batch.column("vec_id"), batch.column("content"), pa.array(ball), spread(pa.array(sizes)), spread(pa.array(wide)), spread(pa.array(scale)), spread(_binary(small)), pa.array(lists.astype(np.int32)), spread(_binary(visits)), spread(_binary(code)), spread(pa.array(err))],
        names=["uid", "vec_id", "content", "ball", "n", "r", "scale", "centre", "list", "visits", "code", "err"],
    )


_BALL = "ball long, n long, r double, scale double, centre binary, list int, visits binary, code binary, err double"


def _merged(model, radius: float):
    """Balls of a part of a list, folded again: (from, to), and what describes `to` in its first row."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value
        for batch in _table(batches, FOLDED):
            ball, n, r, scale, lists = _numbers(batch, "ball", "n", "r", "scale", "list")
            x = _matrix(batch.column("centre"), np.int8, index.dim) * scale[:, None]
            of, firsts, small, scale, wide, sizes = _folded(index, x, r, n, lists, radius)
            rows = pa.RecordBatch.from_arrays([pa.array(ball), pa.nulls(len(ball), pa.int64()), pa.nulls(len(ball), pa.int64())], names=["uid", "vec_id", "content"])
            out = _described_rows(index, rows, ball[firsts][of], firsts, small, scale, wide, sizes, lists)
            yield pa.RecordBatch.from_arrays([out.column("uid"), *(out.column(c) for c in _names(_BALL))], names=["old", *_names(_BALL)])

    return run


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _fold_again(found: DataFrame, model, radius: float) -> tuple[DataFrame, DataFrame | None]:
    """Balls after those of crowded lists have folded, by parts, until that helps no more; and (old, ball) of what changed."""
    moved = None
    while True:
        crowded = found.groupBy("list").agg(F.count("*").alias("k")).where(F.col("k") > MANY)
        if crowded.isEmpty():
            return found, moved
        parts = found.join(crowded, "list").withColumn("part", F.pmod(F.xxhash64("ball", F.lit("part")), F.ceil(F.col("k") / FOLDED)).cast("int"))
        again = cut(parts.groupBy("list", "part").applyInArrow(_merged(model, radius), f"old long, {_BALL}"), "merged-balls")
        before, after = again.agg(F.count("*"), F.count("n")).first()
        if after > 0.9 * before:
            return found, moved
        step = again.select("old", F.col("ball").alias("to"))
        found = cut(found.join(crowded, "list", "left_anti").unionByName(again.where("n IS NOT NULL").drop("old")), "balls")
        if moved is None:
            moved = step.select("old", F.col("to").alias("ball"))
        else:
            moved = moved.join(step.withColumnRenamed("old", "ball"), "ball", "left").select("old", F.coalesce("to", "ball").alias("ball")).unionByName(step.select("old", F.col("to").alias("ball")).join(moved.select("old"), "old", "left_anti"))


# --- search -----------------------------------------------------------------------------------------------------


def _visiting(model):
    """(list, n, balls, radii, scales, centres): the balls of a task that visit a list, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value
        for batch in _table(batches, FOLDED):
            ball, r, scale = _numbers(batch, "ball", "r", "scale")
            small = _matrix(batch.column("centre"), np.int8, index.dim)
            visits = np.frombuffer(b"".join(batch.column("visits").to_pylist()), np.int32).reshape(len(ball), -1)
            row = np.repeat(np.arange(len(ball)), visits.shape[1])
            order = np.argsort(visits.ravel(), kind="stable")
            at, row = visits.ravel()[order], row[order]
            starts, ends = owner_cuts(at)
            cuts = [(a, min(a + VISITORS, b)) for s, b in zip(starts.tolist(), ends.tolist(), strict=True) for a in range(s, b, VISITORS)]
            packed = lambda v: pa.array([np.ascontiguousarray(v[row[a:b]]).tobytes() for a, b in cuts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([at[a] for a, _ in cuts], pa.int32()), pa.array([b - a for a, b in cuts], pa.int64()), packed(ball), packed(r.astype(np.float32)), packed(scale), packed(small)],
                names=["list", "n", "balls", "radii", "scales", "centres"],
            )

    return run


def _met(model, reach: float):
    """Pairs (a, b) of balls of a block of a list and its visitors that may hold linked vectors."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at = model.value, key[0].as_py()
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        sides = {s: rows.filter(pc.equal(rows["side"], s)) for s in (0, 1)}
        own = sides[0]
        if not own.num_rows or not sides[1].num_rows:
            return
        joined = lambda t, c: b"".join(t[c].to_pylist())
        ball, r, err = (np.frombuffer(joined(own, c), k) for c, k in (("balls", np.int64), ("radii", np.float32), ("errs", np.float32)))
        code = np.frombuffer(joined(own, "codes"), np.uint8).reshape(len(ball), index.parts)
        for visit in sides[1].to_batches(1):
            theirs, tr, scale = (np.frombuffer(visit.column(c)[0].as_py(), k) for c, k in (("balls", np.int64), ("radii", np.float32), ("scales", np.float64)))
            x = np.frombuffer(visit.column("centres")[0].as_py(), np.int8).reshape(len(theirs), index.dim)
            for i in range(0, len(theirs), 256):
                part = slice(i, i + 256)
                far = index.distances((x[part] * scale[part, None]).astype(np.float32), at, code)
                v, m = np.nonzero((far <= reach + tr[part, None] + (r + err)[None, :] + 1e-3) & (theirs[part, None] != ball[None, :]))
                if len(v):
                    a, b = theirs[part][v], ball[m]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _packed_members(parts: int):
    """(list, block, balls, radii, errs, codes): index rows, packed map-side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _table(batches, FOLDED):
            lists, block, ball, r, err = _numbers(batch, "list", "block", "ball", "r", "err")
            code = _matrix(batch.column("code"), np.uint8, parts)
            order = np.lexsort((block, lists))
            starts, ends = owner_cuts(lists[order].astype(np.int64) << 32 | block[order])
            packed = lambda v: pa.array([np.ascontiguousarray(v[order[a:b]]).tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(lists[order[starts]]), pa.array(block[order[starts]]), packed(ball), packed(r.astype(np.float32)), packed(err.astype(np.float32)), packed(code)], names=["list", "block", "balls", "radii", "errs", "codes"])

    return run


def _candidates(found: DataFrame, model, reach: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of balls that a visit shows."""
    visits = found.mapInArrow(_visiting(model), "list int, n long, balls binary, radii binary, scales binary, centres binary")
    held = found.groupBy("list").agg(F.count("*").alias("m"))
    # Blocks of the balls of a list and of its visitors, who are `probes` times as many as balls on the whole.
    sizes = cut(held.select("list", F.ceil(F.col("m") / BLOCK).cast("int").alias("k"), F.ceil(F.col("m") * model.value.probes * 2 / VISITORS).cast("int").alias("v")), "list-sizes")
    block = F.pmod(F.xxhash64("ball", F.lit("block")), F.col("k")).cast("int").alias("block")
    members = found.join(sizes, "list").select("list", block, "ball", "r", "err", "code").mapInArrow(_packed_members(model.value.parts), "list int, block int, balls binary, radii binary, errs binary, codes binary")
    index = members.join(sizes.select("list", "v"), "list").select("list", "block", F.explode(F.sequence(F.lit(0), F.col("v") - 1)).alias("share"), F.lit(0).alias("side"), "balls", "radii", "errs", "codes")
    dealt = visits.join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"), F.pmod(F.xxhash64("balls"), F.col("v")).cast("int").alias("share"), F.lit(1).alias("side"), "balls", "radii", "scales", "centres")
    both = index.unionByName(dealt, allowMissingColumns=True)
    return both.groupBy("list", "block", "share").applyInArrow(_met(model, reach), "a long, b long").distinct()


# --- rerank -----------------------------------------------------------------------------------------------------


def _judged(dim: int, reach: float):
    """Pairs (a, b, na, nb, whole) that the centres do not tell apart: linked as a whole, or mixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _table(batches, FOLDED):
            x, y = (_matrix(batch.column(c), np.int8, dim) * batch.column(s).to_numpy()[:, None] for c, s in (("ca", "sa"), ("cb", "sb")))
            far, wide = np.sqrt(((x - y) ** 2).sum(axis=1)), batch.column("ra").to_numpy() + batch.column("rb").to_numpy()
            near = far - wide <= reach + SLACK
            whole = far + wide <= reach - SLACK
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(whole)], names=["a", "b", "na", "nb", "whole"]).filter(pa.array(near))

    return run


def _compared(dim: int, threshold: float):
    """(a, b, uid, links): how many vectors of the other chunk each vector of a mixed pair is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, left, right = (batch.column(c)[i] for c in ("a", "b", "xs", "ys"))
                ids, x = _chunk(left.values, dim)
                others, y = _chunk(right.values, dim)
                linked = x @ y.T >= threshold
                mine, theirs = linked.sum(axis=1), linked.sum(axis=0)
                uid, links = np.concatenate((ids, others)), np.concatenate((mine, theirs))
                some = links > 0
                m = int(some.sum())
                yield pa.RecordBatch.from_arrays([pa.array([a.as_py()] * m, pa.int64()), pa.array([b.as_py()] * m, pa.int64()), pa.array(uid[some]), pa.array(links[some].astype(np.int64))], names=["a", "b", "uid", "links"])

    return run


def _chunk(rows: pa.StructArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return rows.field("uid").to_numpy(zero_copy_only=False), unit(rows.field("vec"), dim)


def _mixed_links(mixed: DataFrame, members: DataFrame, vectors: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(a, b, uid, links) of the members of mixed pairs (a, b, na, nb), by their cosines."""
    sizes = mixed.select(F.col("a").alias("ball"), F.col("na").alias("n")).union(mixed.select("b", "nb")).distinct()
    wanted = cut(members.join(sizes, "ball").select("ball", "n", "uid", "vec_id", "content"), "mixed-members")
    same = F.col("m.vec_id").eqNullSafe(F.col("v.vec_id")) & (F.col("m.content") == F.col("v.content"))
    keys = wanted.select("vec_id", "content").distinct()
    fetched = cut(vectors.alias("v").join(keys.alias("m"), same, "left_semi").select("vec_id", "content", "vec").dropDuplicates(["vec_id", "content"]), "mixed-vectors")
    placed = wanted.alias("m").join(fetched.alias("v"), same).select("ball", "n", "uid", "vec")
    chunk = F.pmod(F.xxhash64("uid", F.lit("chunk")), F.ceil(F.col("n") / CHUNK)).alias("chunk")
    chunks = cut(placed.groupBy("ball", chunk).agg(F.collect_list(F.struct("uid", "vec")).alias("rows")), "mixed-chunks")
    left = mixed.join(chunks.select(F.col("ball").alias("a"), F.col("rows").alias("xs")), "a")
    both = left.join(chunks.select(F.col("ball").alias("b"), F.col("rows").alias("ys")), "b")
    return both.select("a", "b", "xs", "ys").mapInArrow(_compared(dim, threshold), "a long, b long, uid long, links long")


# --- the operator -----------------------------------------------------------------------------------------------


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, list_size: int = LIST_SIZE, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id_column, n_links, component_id, kept: one row for each row of table."""
    spark, reach = table.sparkSession, chord(threshold)
    kind = table.schema[column].dataType
    item = "float" if kind.simpleString() == "array<float>" else "double"
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast(f"array<{item}>").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(finite & F.exists("vec", lambda v: v != 0), F.lit(False))
    counts = rows.where(usable).groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not counts:
        return alone(rows).withColumnRenamed("vec_id", id_column)
    dim, n = counts[0]
    usable = F.coalesce((F.size("vec") == dim) & finite & F.exists("vec", lambda v: v != 0), F.lit(False))
    vectors = rows.where(usable).withColumn("content", F.xxhash64("vec"))
    # Any two of a ball are within twice its radius: a little less than the chord.
    radius = 0.999 * reach / 2

    sample = vectors.orderBy(F.xxhash64("content", "vec_id"), "content", "vec_id").limit(max(1, min(MAX_TRAIN, MAX_TRAIN_VALUES // dim))).select("vec").toArrow()
    index = Index(unit(sample["vec"].combine_chunks(), dim), max(1, min(FINE * FINE, -(-n // list_size))), probes)
    model = spark.sparkContext.broadcast(index)

    placed = cut(vectors.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "content", "vec").mapInArrow(_placed(model, radius), _PLACED), "placed-vectors")
    found, moved = _fold_again(placed.where("n IS NOT NULL").select(*_names(_BALL)), model, radius)
    members = placed.select("uid", "vec_id", "content", "ball")
    if moved is not None:
        members = members.join(moved.select(F.col("old").alias("ball"), F.col("ball").alias("to")), "ball", "left").select("uid", "vec_id", "content", F.coalesce("to", "ball").alias("ball"))

    candidates = cut(_candidates(found, model, reach), "ball-pairs")
    facts = found.select("ball", "n", "r", "scale", "centre")
    side = lambda s: facts.select(F.col("ball").alias(s), F.col("n").alias(f"n{s}"), F.col("r").alias(f"r{s}"), F.col("scale").alias(f"s{s}"), F.col("centre").alias(f"c{s}"))
    judged = cut(candidates.join(side("a"), "a").join(side("b"), "b").mapInArrow(_judged(dim, reach), "a long, b long, na long, nb long, whole boolean"), "judged-pairs")
    whole, mixed = judged.where("whole"), judged.where("NOT whole")
    counted = cut(_mixed_links(mixed, members, vectors, dim, threshold), "mixed-links")

    grouped = components(whole.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(counted.select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()))
    more = whole.select(F.col("a").alias("ball"), F.col("nb").alias("n")).union(whole.select("b", "na")).groupBy("ball").agg(F.sum("n").alias("more"))
    own = counted.groupBy("uid").agg(F.sum("links").alias("own"))
    # Balls that say something of their members: more than one, or linked with others.
    told = facts.select("ball", "n").join(more, "ball", "left").join(grouped.withColumnRenamed("id", "ball"), "ball", "left").where("n > 1 OR more IS NOT NULL OR component IS NOT NULL")
    told = cut(told.select("ball", F.col("n") - 1 + F.coalesce("more", F.lit(0)), F.coalesce("component", "ball").alias("component")).toDF("ball", "others", "component"), "told-balls")
    # A component is named by its smallest id, null before all others.
    names = members.join(told.select("ball", "component"), "ball").groupBy("component").agg(F.min(F.struct(F.col("vec_id").isNotNull().alias("has"), F.col("vec_id").alias("id"))).alias("least"))
    of_ball = told.join(names, "component").select("ball", "others", F.col("least.id").alias("component_id"), F.lit(True).alias("named"))
    joined = members.join(of_ball, "ball", "left").join(own, "uid", "left")
    component = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("vec_id"))
    linked = joined.select("vec_id", (F.coalesce("others", F.lit(0)) + F.coalesce("own", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"))
    out = linked.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    return out.unionByName(alone(rows.where(~usable))).withColumnRenamed("vec_id", id_column)
