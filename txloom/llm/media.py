"""Copies of images by local descriptors: corners at several scales, binary tests turned to the patch's own orientation,
Hamming tables, and geometric consensus.

An image is a raw grey raster (width, height, bytes). At each scale (halved by means) the strongest Harris corner of
each cell is kept; a patch's orientation is the direction of its centroid of intensity; the descriptor is 64 fixed
comparisons of smoothed pixels, their places turned by that orientation. Distinct descriptors are filed in 4 tables
under one part of their bits each, so two that differ in at most 3 bits share an entry; a full entry is parted again by its other bits. Features of such
descriptors vote for the scale step and shift they imply, and images with `consensus` votes of either one's places for
one shift (in bins that overlap by half) are linked. Links give groups, the same as if all pairs were compared (`links`).

The supplied tables hold no images: the query reads each page's html as a raster 64 bytes wide.

Rows of equal width and bytes are linked whatever features they have, and one of them meets the others' features.

Edge cases: null, empty and too small rasters have no features, and but for equal ones are groups of their own; repeated rows of an id are
one image; null ids take no part; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txloom.llm.common import stage, table, tidied, unstage
from txloom.llm.components import components

SCALES, CELL, RADIUS, TURNS = 3, 12, 6, 32
DISTANCE, CONSENSUS, BIN = 3, 4, 4
#: The least side of an image with features; images taken and pixels worked on at once (a larger image is taken whole).
LEAST, ROWS, PIXELS = 2 * RADIUS + 3, 1024, 1 << 17
#: Descriptors of a run compared with each other; rows of a task looked at together.
RUN, TOGETHER = 16, 1 << 18
#: A descriptor of a group is common if more descriptors of groups than this meet it.
HOT = 32


def _tests() -> np.ndarray:
    """Places of the 64 comparisons for each turn of the patch: turn x test x (y1, x1, y2, x2)."""
    rng = np.random.default_rng(11)
    p = np.clip(rng.normal(0, RADIUS / 2.2, (64, 2, 2)), -RADIUS + 1, RADIUS - 1)
    out = []
    for t in range(TURNS):
        a = 2 * np.pi * t / TURNS
        turn = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])  # on (y, x)
        out.append(np.clip(np.rint(p @ turn.T), -RADIUS, RADIUS).reshape(64, 4))
    return np.array(out, int)


TESTS = _tests()
_Y, _X = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = _Y**2 + _X**2 <= RADIUS**2


def _edge(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Repeats each image's last row below it; a: images (n, rows, columns) of which the first h[i] rows are image i."""
    k = np.arange(len(a))
    a[k, h] = a[k, h - 1]
    return a


def _box(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Means of 3 by 3 pixels, edges repeated."""
    p = np.pad(_edge(a, h), ((0, 0), (1, 1), (1, 1)), mode="edge")
    rows = p[:, :-2] + p[:, 1:-1] + p[:, 2:]
    return (rows[:, :, :-2] + rows[:, :, 1:-1] + rows[:, :, 2:]) / 9


def _corners(a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Image, y, x and descriptor of the corners of images of one width and h[i] rows each, which lie in a (n, more rows, width)."""
    k, m = np.arange(len(a)), RADIUS + 1
    s = _box(a, h)
    gy, gx = np.gradient(s, axis=(1, 2))
    gy[k, h - 1] = s[k, h - 1] - s[k, h - 2]
    xx, yy, xy = _box(gx * gx, h), _box(gy * gy, h), _box(gx * gy, h)
    r = np.round(xx * yy - xy * xy - 0.05 * (xx + yy) ** 2, 6)
    r[np.arange(r.shape[1]) >= h[:, None]] = -np.inf
    p = np.pad(r, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
    rows = np.maximum(np.maximum(p[:, :-2], p[:, 1:-1]), p[:, 2:])
    peak = (r > 0) & (r >= np.maximum(np.maximum(rows[:, :, :-2], rows[:, :, 1:-1]), rows[:, :, 2:]))
    peak[np.arange(r.shape[1]) >= h[:, None] - m] = False
    i, y, x = np.nonzero(peak[:, m:, m : a.shape[2] - m])
    y, x = y + m, x + m
    around = lambda of, half: np.lib.stride_tricks.sliding_window_view(of, (2 * half + 1,) * 2, (1, 2))[i, y - half, x - half]
    # strongest within a cell around it: a rule that crops do not move
    best = r[i, y, x] >= around(r, CELL // 2).max(axis=(1, 2))
    i, y, x = i[best], y[best], x[best]
    patch = around(s, RADIUS) * _DISC
    angle = np.arctan2(*((patch * of).reshape(len(i), of.size).sum(axis=1) for of in (_Y, _X)))
    t = TESTS[np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS]
    at = i[:, None]
    bits = s[at, y[:, None] + t[:, :, 0], x[:, None] + t[:, :, 1]] < s[at, y[:, None] + t[:, :, 2], x[:, None] + t[:, :, 3]]
    return i, y, x, np.packbits(bits, axis=1).view(">i8").reshape(-1).astype(np.int64)


def all_features(images: list[np.ndarray]) -> list[np.ndarray]:
    """Image, scale, y, x and descriptor of the corners of grey images; places are in pixels of that scale.
    Images of one width and similar heights are laid into one array, PIXELS of them at once, and worked on together."""
    out: list[tuple] = []
    order = sorted((a.shape[1], len(a), k) for k, a in enumerate(images) if min(a.shape) >= LEAST)
    while order:
        # from the highest down, as many as fit under its height
        w, high, _ = order[-1]
        part = [k for width, _, k in order[-max(1, PIXELS // (w * high)) :] if width == w]
        del order[-len(part) :]
        own, h = np.array(part), np.array([len(images[k]) for k in part])
        a = np.zeros((len(part), high + 1, w))
        for i, k in enumerate(part):
            a[i, : h[i]] = images[k]
        for scale in range(SCALES):
            if min(h.max(initial=0), a.shape[2]) < LEAST:
                break
            if h.min() < LEAST:
                a, own, h = a[h >= LEAST], own[h >= LEAST], h[h >= LEAST]
            i, y, x, bits = _corners(a, h)
            out.append((own[i], np.full(len(i), scale), y, x, bits))
            n, rows, columns = a.shape
            half = a[:, : rows // 2 * 2, : columns // 2 * 2].reshape(n, rows // 2, 2, columns // 2, 2).mean(axis=(2, 4))
            h = h // 2
            a = np.pad(half, ((0, 0), (0, 1), (0, 0)))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


def features(image: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(scale, y, x, descriptor) of the corners of a grey image."""
    return list(zip(*(c.tolist() for c in all_features([image])[1:])))


def describe(images: DataFrame) -> DataFrame:
    """id, scale, y, x, bits of every feature. images: id (long), width, pixels (BINARY; the height follows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids, rasters = [], []
                for i, w, b in zip(*(batch.column(k).slice(at, ROWS).to_pylist() for k in range(3))):
                    h = len(b or b"") // w if w and w > 0 else 0
                    if h:
                        ids.append(i)
                        rasters.append(np.frombuffer(b, np.uint8, h * w).reshape(h, w))
                own, *rest = all_features(rasters)
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(t) for c, t in zip([np.array(ids, np.int64)[own], *rest], kinds)], ["id", "scale", "y", "x", "bits"])

    return images.where("id is not null").select("id", "width", "pixels").mapInArrow(run, "id long, scale int, y int, x int, bits long")


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal entries."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return starts, np.diff(np.r_[starts, len(key)])


def _within(v: np.ndarray, free: list[int]) -> list[np.ndarray]:
    """Arrays of two rows: the pairs of the distinct numbers v (unsigned) that agree but for DISTANCE of the `free` bits at
    most. Runs that agree elsewhere are compared; a long one is parted by DISTANCE + 1 parts of its free bits, one of
    which agrees, so the work follows the numbers and not the squares of their common parts."""
    key = v & np.uint64(((1 << 64) - 1) ^ sum(1 << b for b in free))
    order = np.argsort(key)
    v, (starts, long) = v[order], _runs(key[order])
    each = np.repeat(long, long)
    place, out = np.arange(len(v)) - np.repeat(starts, long), []
    apart = each > RUN if len(free) > 2 * (DISTANCE + 1) else np.zeros(len(v), bool)
    near = np.flatnonzero(~apart & (each > 1))
    for d in range(1, int(each[near].max(initial=0))):
        near = near[place[near] + d < each[near]]
        a, b = v[near], v[near + d]
        close = np.bitwise_count(a ^ b) <= DISTANCE
        out.append(np.stack([a[close], b[close]]))
    if apart.any():
        for part in range(DISTANCE + 1):
            out += _within(v[apart], [b for n, b in enumerate(free) if n % (DISTANCE + 1) != part])
    return out


def _whole(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, about `rows` rows at once, cut where one of the first `keys` columns changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(h[0]) for h in held) >= rows:
            cols = [np.concatenate(c) for c in zip(*held)]
            new = np.flatnonzero(reduce(np.logical_or, [c[1:] != c[:-1] for c in cols[:keys]]))
            cut = int(new[-1]) + 1 if len(new) else 0
            if cut:
                yield [c[:cut] for c in cols]
            held = [[c[cut:] for c in cols]]
    if held and sum(len(h[0]) for h in held):
        yield [np.concatenate(c) for c in zip(*held)]


def near_descriptors(bits: DataFrame) -> DataFrame:
    """bits, other: the pairs of the distinct descriptors `bits` within DISTANCE, each once, the smaller first.
    Two that differ in at most 3 of 64 bits agree in one of 4 parts, so they meet under one of 4 keys of 16 bits."""
    keys = F.array(*[F.struct(F.shiftrightunsigned("bits", 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int").bitwiseOR(F.lit(k << 16)).alias("key"), "bits") for k in range(DISTANCE + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, v in _whole(batches, 1, TOGETHER):
            found = [np.zeros((2, 0), np.uint64)]
            for k in range(DISTANCE + 1):
                found += _within(v[key >> 16 == k].view(np.uint64), [b for b in range(64) if b // 16 != k])
            a, b = np.concatenate(found, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["bits", "other"])

    rows = bits.select(F.explode(keys).alias("k")).select("k.*").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "bits long, other long").distinct()


def _packed(*cols: np.ndarray) -> np.ndarray:
    """One number for each row, equal where all columns are, in their order."""
    out, size = np.zeros(len(cols[0]), np.int64), 1
    for c in cols:
        least = int(c.min(initial=0))
        n = int(c.max(initial=0)) - least + 1
        if size * n >= 1 << 62:
            kinds, out = np.unique(out, return_inverse=True)
            size = len(kinds)
        out, size = out * n + (c - least), size * n
    return out


#: A place as one number.
SPOT = "shiftleft(cast(scale as bigint), 56) | shiftleft(cast(y as bigint), 28) | cast(x as bigint)"


def _places(spots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scale, y and x of places that SPOT made."""
    return spots >> 56, spots >> 28 & (1 << 28) - 1, spots & (1 << 28) - 1


def _votes(pair: np.ndarray, n: int, mine: np.ndarray, theirs: np.ndarray, enough: int) -> np.ndarray:
    """The most votes of each of n pairs' own places for one shift (once `enough`, not counted further). Row: a pair, a place, a place that it meets."""
    most = np.zeros(n, np.int64)
    scale, y, x = _places(mine)
    down, *right = _places(theirs)
    step, (dy, dx) = down - scale, (v - u << down for u, v in zip((y, x), right))
    for low, left in ((0, 0), (0, 1), (1, 0), (1, 1)):  # bins that overlap by half
        some = most[pair] < enough
        p = pair[some]
        bins = _packed(p, step[some], (dy[some] + low * BIN // 2) // BIN, (dx[some] + left * BIN // 2) // BIN)
        order = np.lexsort((mine[some], bins))
        bins, place, p = bins[order], mine[some][order], p[order]
        own = np.r_[True, (bins[1:] != bins[:-1]) | (place[1:] != place[:-1])][: len(bins)]
        first, votes = _runs(bins[own])
        np.maximum.at(most, p[own][first], votes)
    return most


def voted(met: DataFrame, consensus: int) -> DataFrame:
    """a, b, bits, other, sure: the rows of the pairs of owners whose met features (bits, other; spots: a's places; theirs:
    b's, all of which they meet) have `need` votes of a's places for one shift; sure: `consensus` votes. Two lists meet in
    their task, and not as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, bits, to, need, mine, theirs in _whole(batches, 2, TOGETHER):
            starts, long = _runs(_packed(a, b))
            own, other = (np.fromiter(map(len, c), np.int64, len(c)) for c in (mine, theirs))
            upto = np.r_[0, np.cumsum(own * other)]
            ends = upto[starts + long]
            most, k = np.zeros(len(starts), np.int64), 0
            while k < len(starts):  # as many pairs at once as give TOGETHER places that meet, or one
                end = max(k + 1, int(np.searchsorted(ends, upto[starts[k]] + TOGETHER, "right")))
                lo, hi = starts[k], starts[end - 1] + long[end - 1]
                n, m = own[lo:hi], other[lo:hi]
                row = np.repeat(np.arange(hi - lo), n * m)
                at = np.arange(len(row)) - (upto[lo:hi] - upto[lo])[row]
                left, right = (np.concatenate(c[lo:hi])[(np.cumsum(size) - size)[row] + i] for c, size, i in ((mine, n, at // m[row]), (theirs, m, at % m[row])))
                most[k:end] = _votes(np.repeat(np.arange(end - k), long[k:end])[row], end - k, left, right, consensus)
                k = end
            most = np.repeat(most, long)
            ok = most >= need
            yield pa.RecordBatch.from_arrays([*(pa.array(c[ok]) for c in (a, b, bits, to)), pa.array(most[ok] >= consensus)], ["a", "b", "bits", "other", "sure"])

    rows = met.select("a", "b", "bits", "other", "need", "spots", "theirs")
    return rows.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(run, "a long, b long, bits long, other long, sure boolean")


def links(f: DataFrame, consensus: int) -> DataFrame:
    """a, b: links between images (features f: id, scale, y, x, bits) that connect all that links of every pair would.
    If f is staged, its files go when they have been read.

    First each image meets, for each descriptor, the one with the most of all that hold a descriptor near it; what that
    connects is a group. Then groups meet: all descriptors within DISTANCE, by the union of a group's features, whose votes bound those of its images. A descriptor's
    places in a group are one list, so a pattern that repeats within images is one row where two groups meet. Where
    `consensus` places agree, `consensus` - k agree outside any k, so a group asks without its commonest descriptors (those
    that over HOT groups meet, `consensus` - 2 places at most) and needs as many votes fewer. Last, the images of groups
    that could be linked are compared descriptor by descriptor, unless each is one image that has all votes."""
    full = F.lit(consensus).cast("long")
    kinds = stage(f.groupBy("bits").agg((F.min("id") < F.max("id")).alias("shared")))
    once = stage(near_descriptors(kinds.select("bits")))
    near = stage(once.union(once.select(F.col("other").alias("bits"), F.col("bits").alias("other"))).union(kinds.where("shared").select("bits", F.col("bits").alias("other"))))
    unstage(once)
    unstage(kinds)
    met = stage(f.join(near.select("bits").distinct(), "bits", "left_semi").groupBy("id", "bits").agg(F.collect_set(F.expr(SPOT)).alias("spots")))
    unstage(f)
    rank = F.struct("n", -F.col("id"))
    holder = met.join(met.groupBy("id").agg(F.count("*").alias("n")), "id").groupBy(F.col("bits").alias("other")).agg(F.max(rank).alias("n"), F.max_by(F.struct(F.col("id").alias("b"), F.col("spots").alias("theirs")), rank).alias("r"))
    holder = near.join(holder, "other").groupBy("bits").agg(F.max_by(F.struct("other", "r.*"), F.struct("n", "other")).alias("r")).select("bits", "r.*")
    early = stage(voted(met.join(holder, "bits").where("id <> b").withColumns({"a": F.col("id"), "need": full}), consensus).select("a", "b").distinct())
    groups = components(early).withColumnRenamed("node", "id")
    of = stage(met.join(groups, "id", "left").withColumn("g", F.coalesce("label", "id")).drop("label"))
    unstage(met)
    met = of
    # descriptors that meet only within one group have no votes to give
    ends = met.groupBy("bits").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
    theirs = ends.select(F.col("bits").alias("other"), F.col("lo").alias("low"), F.col("hi").alias("high"))
    across = stage(near.join(ends, "bits").join(theirs, "other").where(F.least("lo", "low") < F.greatest("hi", "high")).select("bits", "other"))
    unstage(near)
    near = across
    owned = stage(met.join(near.select("bits").distinct(), "bits", "left_semi"))
    unstage(met)
    whole = owned.groupBy("g", "bits").agg(F.array_distinct(F.flatten(F.collect_list("spots"))).alias("spots"))
    whole = stage(whole.withColumn("k", F.size("spots").cast("long")))
    heat = near.join(whole.groupBy(F.col("bits").alias("other")).agg(F.count("*").alias("n")), "other").groupBy("bits").agg(F.sum("n").alias("heat")).where(F.col("heat") > HOT)
    upto = F.sum("k").over(Window.partitionBy("g").orderBy(F.desc("heat"), "bits").rowsBetween(Window.unboundedPreceding, 0))
    left = stage(whole.where(F.col("k") <= consensus - 2).join(heat, "bits").withColumn("upto", upto).where(F.col("upto") <= consensus - 2).select("g", "bits", "k"))
    able = whole.groupBy("g").agg(F.sum("k").alias("places")).where(F.col("places") >= consensus)
    able = able.join(left.groupBy("g").agg(F.sum("k").alias("less")), "g", "left").select("g", (full - F.coalesce("less", F.lit(0))).alias("need"))
    asking = whole.join(left, ["g", "bits"], "left_anti").join(able, "g").select("g", "need", "bits", "spots")
    theirs = whole.select(F.col("g").alias("h"), F.col("bits").alias("other"), F.col("spots").alias("theirs"))
    met = asking.join(near, "bits").join(theirs, "other").where("g <> h").withColumns({"a": F.col("g"), "b": F.col("h")})
    maybe = stage(voted(met, consensus).withColumnsRenamed({"a": "g", "b": "h"}))
    many = groups.select(F.col("label").alias("g")).distinct().withColumn("many", F.lit(True))
    pairs = maybe.groupBy("g", "h").agg(F.first("sure").alias("sure")).join(many, "g", "left").join(many.select(F.col("g").alias("h"), F.col("many").alias("more")), "h", "left")
    pairs = stage(pairs.select("g", "h", (F.col("sure") & F.col("many").isNull() & F.col("more").isNull()).alias("single")))
    found = [early, pairs.where("single").select(F.col("g").alias("a"), F.col("h").alias("b"))]
    # what the pairs asked, and the few descriptors that they did not ask
    unsure = pairs.where("not single").select("g", "h")
    near = (F.bit_count(F.col("bits").bitwiseXOR(F.col("other"))) <= DISTANCE)
    unasked = unsure.join(left.select("g", "bits"), "g").join(theirs.select("h", "other"), "h").where(near)
    rows = stage(maybe.join(unsure, ["g", "h"], "left_semi").select("g", "h", "bits", "other").union(unasked.select("g", "h", "bits", "other")))
    for done in (whole, left, maybe):
        unstage(done)
    # first the image of each group with the most features that meet others, then all images of the pairs still open
    chief = owned.groupBy("g", "id").agg(F.sum(F.size("spots")).alias("n")).groupBy("g").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("id"))
    for last, of in enumerate((owned.join(chief, ["g", "id"], "left_semi"), owned)):
        mine = of.select("g", F.col("id").alias("a"), "bits", "spots")
        theirs = of.select(F.col("g").alias("h"), F.col("id").alias("b"), F.col("bits").alias("other"), F.col("spots").alias("theirs"))
        met = rows.join(mine, ["g", "bits"]).join(theirs, ["h", "other"]).withColumn("need", full)
        linked = stage(voted(met, consensus).select("a", "b").distinct())
        found.append(linked)
        if not last:
            # pairs that are connected by now have nothing to add
            known = components(reduce(DataFrame.union, found))
            ends = [known.select(F.col("node").alias(c), F.col("label").alias(f"{c}_in")) for c in "gh"]
            rows = stage(rows.join(ends[0], "g", "left").join(ends[1], "h", "left").where(F.coalesce("g_in", "g") != F.coalesce("h_in", "h")).select("g", "h", "bits", "other"))
    unstage(owned)
    return reduce(DataFrame.union, found)


def copies(images: DataFrame, consensus: int = CONSENSUS) -> DataFrame:
    """As grouped; the shuffles of a table that is staged go as soon as it is written."""
    with tidied(images.sparkSession):
        return grouped(images, consensus)


def grouped(images: DataFrame, consensus: int) -> DataFrame:
    """id, n_features, copy_of (the smallest id of the group that links connect) for each distinct id."""
    f = stage(describe(images).distinct())
    counts = stage(f.groupBy("id").agg(F.count("*").alias("n_features")))
    counts = images.where("id is not null").select("id").distinct().join(counts, "id", "left")
    rasters = images.where("id is not null and width > 0 and octet_length(pixels) > 0").select("id", "width", F.sha2("pixels", 256).alias("digest"))
    rasters = stage(rasters.distinct())
    least = rasters.groupBy("width", "digest").agg(F.min("id").alias("b"))
    equal = rasters.join(least, ["width", "digest"]).where("id <> b").select(F.col("id").alias("a"), "b")
    # the smallest id of equal rasters stands for those that have no other raster: it has all their features
    lone = rasters.groupBy("id").count().where("count = 1")
    lone = stage(equal.join(lone, equal["a"] == lone["id"]).select("id"))
    stands = f
    if not lone.isEmpty():
        stands = stage(f.join(lone, "id", "left_anti"))
        unstage(f)
    groups = components(links(stands, consensus).union(equal)).withColumnRenamed("node", "id")
    return counts.join(groups, "id", "left").select("id", F.coalesce("n_features", F.lit(0)).alias("n_features"), F.coalesce("label", "id").alias("copy_of"))


def op3_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among all pages, each read as a raster 64 bytes wide."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit(64).alias("width"), F.col("html").cast("binary").alias("pixels"))
    return copies(pages).withColumnRenamed("id", "page_id")
