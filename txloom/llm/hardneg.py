"""Hard-negative mining by norm-bucketed search.

Vectors are integers, so scores (inner products) are exact. Candidates are sorted by norm and cut into shards, and within a
shard into buckets. A search has windows: only scores from a low to a high limit count, and the k first of them are wanted.
By Cauchy-Schwarz no score in a bucket exceeds the anchor's norm times the bucket's largest, so a bucket is visited only if
that reaches the window's low limit and the k-th best score so far; as norms fall, the first bucket that no window can use
ends the visit. The same bound, asked of whole shards against whole blocks of anchors, says which pairs meet at all: a first
round visits the shard with the largest norms, and the k-th scores found there bound the second round over all others.

Positives are searched among the candidates of the anchor's label (one window without limits), negatives among those of
other labels (a window for each score of a positive). Both rounds are exact for every input: nothing is capped or sampled.

Scale: equal vectors of one label are one class with the few smallest ids that an answer can need, so a vector that a third
of all rows hold costs no more than another; a task holds one block of anchors and one shard. Anchors are a stated set, met
with all rows in blocks; what is sent twice is a shard for each block that can use it.

Edge cases: rows with a null id, label or vector, or a null or non-finite component, take no part, nor do vectors whose
components after scaling have a norm of 2**31 or more (scores are 64-bit numbers); rows meet rows of as many components; of
rows that share an id the one with the smallest label and vector counts, once; equal scores by smaller id; fewer rows than asked for give fewer; an empty table gives none; other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txloom.llm.common import stage, table, unstage

#: Binary logarithms of the rows of a shard and of a block of anchors.
SHARD_BITS, BLOCK_BITS = 15, 12
#: Rows of a bucket, and windows scored at once.
BUCKET, WINDOWS = 512, 2_048
LOWEST, HIGHEST = -(2**63) + 1, 2**63 - 1
#: Room for rounding in bounds.
SLACK = 1 + 1e-9


def quantised(rows: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """id, label, q (array<int>: floor(scale * x) of each component, in double precision), dim of the rows that take part."""
    v = F.col("v")
    rows = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).where(F.forall(v, finite))
    rows = rows.select("id", "label", F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("q"))
    size = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.where(size < 2.0**62).select("id", F.struct("label", F.col("q").cast("array<int>").alias("q")).alias("r"))
    return rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.q", F.size("r.q").alias("dim"))


def classes_of(rows: DataFrame, few: int) -> DataFrame:
    """label, q, dim, norm2, ids: one row for equal vectors of a label, with its `few` smallest ids."""
    order = Window.partitionBy("label", "q").orderBy("id")
    some = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= few)
    norm2 = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    return some.groupBy("label", "q", "dim").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("norm2", norm2)


def matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = col.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((len(col), 0), np.int32)


def lists(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all values, how many in each row)."""
    got = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return got.flatten().to_numpy(zero_copy_only=False).astype(np.int64), got.value_lengths().to_numpy(zero_copy_only=False)


class Shard:
    """Classes sorted by norm, cut into buckets."""

    def __init__(self, rows: pa.Table, dim: int):
        norm2, (ids, sizes) = rows["norm2"].to_numpy(), lists(rows["ids"])
        begins = np.cumsum(sizes) - sizes
        order = np.lexsort((ids[begins], -norm2))
        self.x, self.norm = matrix(rows["q"], dim)[order], np.sqrt(norm2[order].astype(np.float64))
        self.label, self.ids, self.sizes, self.begins = rows["label"].to_numpy()[order], ids, sizes[order], begins[order]
        self.first = ids[self.begins]

    def visit(self, q: np.ndarray, label: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, class, score) of the k first classes of each window. owner: the row of q that a window belongs to; floor:
        a score that k rows are known to reach."""
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        exact = float(norm.max(initial=0)) * float(self.norm.max(initial=0)) < 2.0**53
        q, x = (q.astype(np.float64), self.x.astype(np.float64)) if exact else (q.astype(np.int64), self.x.astype(np.int64))
        need = np.maximum(low, floor)
        win, cls, score = (np.empty(0, np.int64) for _ in range(3))
        for at in range(0, len(x), BUCKET):
            able = np.flatnonzero((norm[owner] * self.norm[at] * SLACK >= need) & (low <= high))
            if not len(able):
                break
            near, of = x[at : at + BUCKET].T, self.label[at : at + BUCKET]
            found = []
            for part in range(0, len(able), WINDOWS):
                w = able[part : part + WINDOWS]
                own, back = np.unique(owner[w], return_inverse=True)
                made = q[own] @ near
                made = (np.rint(made).astype(np.int64) if exact else made)[back]
                fits = (made >= need[w, None]) & (made <= high[w, None]) & ((of[None] == label[owner[w], None]) == same)
                if near.shape[1] > k:
                    made = np.where(fits, made, LOWEST)
                    fits &= made >= np.partition(made, -k, axis=1)[:, -k, None]
                r, c = np.nonzero(fits)
                found.append((w[r], at + c, made[r, c]))
            win, cls, score = (np.concatenate([a, *b]) for a, b in zip((win, cls, score), zip(*found)))
            order = np.lexsort((self.first[cls], -score, win))
            win, cls, score = win[order], cls[order], score[order]
            place = np.arange(len(win)) - np.searchsorted(win, win)
            last = place == k - 1
            need[win[last]] = np.maximum(need[win[last]], score[last])
            win, cls, score = win[place < k], cls[place < k], score[place < k]
        return win, cls, score


def _met(blocks: DataFrame, shards: DataFrame, tiles: DataFrame, k: int, same: bool) -> DataFrame:
    """qid, win, id, score of the tiles (g, dim, block, shard): each block of queries against each shard."""
    key = ["g", "dim", "block", "shard"]

    def run(at: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim, cols = at[1].as_py(), ["qid", "win", "id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, cols)
        low, n = lists(left["lows"])
        high, floor = lists(left["highs"])[0], lists(left["floors"])[0]
        owner, shard = np.repeat(np.arange(left.num_rows), n), Shard(right, dim)
        win, cls, score = shard.visit(matrix(left["q"], dim), left["label"].to_numpy(), owner, low, high, floor, k, same)
        sizes = shard.sizes[cls]
        ids = shard.ids[np.repeat(shard.begins[cls] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        win, score = np.repeat(win, sizes), np.repeat(score, sizes)
        order = np.lexsort((ids, -score, win))
        win, ids, score = win[order], ids[order], score[order]
        kept = np.arange(len(win)) - np.searchsorted(win, win) < k
        win, ids, score = win[kept], ids[kept], score[kept]
        first = np.cumsum(n) - n
        return pa.table([left["qid"].to_numpy()[owner[win]], win - first[owner[win]], ids, score], cols)

    named = lambda df, side: df.select(*[F.col(c).alias(f"{side}_{c}") for c in key[:3]], F.col("shard").alias(f"{side}_shard"), *df.columns[4:])
    left = named(blocks.join(tiles, ["g", "dim", "block"]).select(*key, "qid", "label", "q", "lows", "highs", "floors"), "q")
    right = named(shards.join(tiles, ["g", "dim", "shard"]).select(*key, "label", "q", "norm2", "ids"), "c")
    return left.groupBy(*[f"q_{c}" for c in key]).cogroup(right.groupBy(*[f"c_{c}" for c in key])).applyInArrow(run, "qid long, win long, id long, score long")


def _dealt(rows: DataFrame, name: str, bits: int, *order: Column | str) -> DataFrame:
    """rows in the order of g, dim and `order`, with a number for each run of 2**bits rows."""
    rows = rows.repartitionByRange("g", "dim", *order).sortWithinPartitions("g", "dim", *order)
    return rows.withColumn(name, F.shiftright(F.monotonically_increasing_id(), bits))


def search(queries: DataFrame, candidates: DataFrame, k: int, same: bool) -> DataFrame:
    """qid, win, id, score: the k first candidates of each window, by score and id.

    queries: qid, label, q, dim, norm2, lows, highs (arrays, an entry for each window). candidates: label, q, dim, norm2,
    ids (classes_of). same: candidates of the query's label, or of all others."""
    spark = queries.sparkSession
    g = F.col("label") if same else F.lit(0).cast("long")
    shards = stage(_dealt(candidates.withColumn("g", g), "shard", SHARD_BITS, F.desc("norm2"), F.xxhash64("q", "label")))
    tops = shards.groupBy("g", "dim", "shard").agg(F.max("norm2").alias("top2"))
    seeds = tops.groupBy("g", "dim").agg(F.max_by("shard", F.struct("top2", "shard")).alias("shard"))
    asked = queries.withColumn("g", g).withColumn("floors", F.transform("lows", lambda _: F.lit(LOWEST)))
    first = stage(_dealt(asked, "block", BLOCK_BITS, "norm2", "qid"))
    begun = stage(_met(first, shards, first.select("g", "dim", "block").distinct().join(seeds, ["g", "dim"]), k, same))
    best = Window.partitionBy("qid", "win").orderBy(F.desc("score"), "id")
    known = begun.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k).select("qid", "win", "score")
    known = known.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("win", "score"))).alias("known"))
    floor = F.transform("floors", lambda x, i: F.coalesce(F.try_element_at("known", i.cast("long")), x))
    second = first.join(known, "qid", "left").withColumn("floors", F.when(F.col("known").isNotNull(), floor).otherwise(F.col("floors")))
    # the norm that a candidate needs for the least demanding window that is open
    want = F.array_min(F.zip_with(F.zip_with("lows", "floors", lambda a, b: F.greatest(a, b)), F.arrays_zip("lows", "highs"), lambda x, y: F.when(y["lows"] <= y["highs"], x)))
    need = F.when(want <= 0, 0.0).when(F.col("norm2") == 0, float("inf")).otherwise(want.cast("double") / F.sqrt(F.col("norm2").cast("double")))
    second = second.drop("known", "block").withColumn("need", need).where(F.col("need").isNotNull())
    second = stage(_dealt(second, "block", BLOCK_BITS, "need", "qid"))
    # few rows on either side, one for each block and shard; a copy of the blocks for each part of the shards
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = second.groupBy("g", "dim", "block").agg(F.min("need").alias("need")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rest = tops.join(seeds, ["g", "dim", "shard"], "left_anti").withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int"))
    tiles = blocks.join(rest, ["g", "dim", "part"]).where(F.sqrt(F.col("top2").cast("double")) * SLACK >= F.col("need")).select("g", "dim", "block", "shard")
    more = _met(second, shards, tiles, k, same)
    out = stage(begun.unionByName(more).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n"))
    for used in (shards, first, begun, second):
        unstage(used)
    return out


def mine(vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row that the condition `anchors` (over the key) selects: its first `positives` other rows of the same label, and
    for each of these the first `negatives` rows of other labels that score least to most hundredths of it."""
    spark = vectors.sparkSession
    rows = stage(quantised(vectors, key, vector, label, scale))
    ids = rows.withColumnRenamed("id", key).where(anchors).withColumnRenamed(key, "id")
    candidates = stage(classes_of(rows, max(positives, negatives) + 1))
    asked = stage(candidates.join(ids.select("label", "q", "dim").distinct(), ["label", "q", "dim"], "left_semi").select("label", "q", "dim", "norm2").withColumn("qid", F.monotonically_increasing_id()))
    own = stage(ids.join(asked.select("label", "q", "qid"), ["label", "q"]).select(F.col("id").alias("anchor_id"), "qid"))
    one = lambda x: F.array(F.lit(x))
    near = search(asked.withColumn("lows", one(LOWEST)).withColumn("highs", one(HIGHEST)), candidates, positives + 1, True)
    scores = near.where("score >= 0").groupBy("qid").agg(F.array_sort(F.collect_set("score")).alias("scores"))
    # p >= 0 here: least * p <= 100 * s <= most * p, without a product that could overflow
    low = F.expr(f"transform(scores, p -> (p div 100) * {least} + ((p % 100) * {least} + 99) div 100)")
    high = F.expr(f"transform(scores, p -> (p div 100) * {most} + ((p % 100) * {most}) div 100)")
    hard = search(asked.join(scores, "qid").withColumn("lows", low).withColumn("highs", high).drop("scores"), candidates, negatives + 1, False)
    hard = hard.join(scores, "qid").select("qid", F.element_at("scores", (F.col("win") + 1).cast("int")).alias("positive_score"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    best = Window.partitionBy("anchor_id", "qid").orderBy(F.desc("score"), "id")
    mates = own.join(near.select("qid", "id", "score"), "qid").where("id <> anchor_id").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= positives)
    mates = mates.select("anchor_id", "qid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    order = Window.partitionBy("anchor_id", "qid", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = mates.join(hard, ["qid", "positive_score"]).where("negative_id <> anchor_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every row of embeddings whose vec_id is divisible by 50; every seventh label is moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


OP13_SQL = """
with good as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), true)
), rows as (
  select * from good qualify row_number() over (partition by vec_id order by label, q) = 1
), cells as (select vec_id, label, unnest(q) as x, unnest(range(len(q))) as i, len(q) as dim from rows),
pairs as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, sum(a.x * b.x)::bigint as score
  from cells a join cells b on a.i = b.i and a.dim = b.dim where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id group by all
), positives as (
  select anchor_id, id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id)::int as rank, id as negative_id, positive_score, score as negative_score
from positives join pairs using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 3
"""
