"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a long hash string, the signs of its products with 64 random directions, and keeps the
strings as one sorted array. A query descends to its longest prefix match in each tree; then all trees ascend
together, one prefix length at a time, and every vector that comes to share the prefix in any tree is a candidate,
scored by its exact cosine. The ascent stops when the neighbours found so far say that enough was seen: if the
k-th best has angle t, a vector at that angle shares a prefix of length b in one of T trees with probability
1 - (1 - (1 - t/pi)^b)^T, which must reach `surety`. So there is no cap on candidates, queries with close
neighbours stop early, and the rule is the same at every size.

Identical vectors are one class in the index, with only the k + 1 smallest ids that an answer can need, so a vector
that a third of all rows hold costs no more than another. Classes are dealt by hash over shards of about `shard_rows`;
queries go to every shard in blocks.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, neither as queries nor as
candidates; null ids take no part; repeated rows (same id and vector) count once; fewer candidates than k give
fewer rows; an empty table gives none; other columns are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txloom.llm.common import stage, table

TREES = 96
BITS = 64
SURETY = 0.96
SHARD_ROWS = 65_536
QUERY_ROWS = 8_192


def directions(dim: int, trees: int) -> np.ndarray:
    """Random unit-variance directions, the same in every task."""
    return np.random.default_rng(20240501).standard_normal((trees, dim, BITS))


class Forest:
    """Sorted arrays of hash strings over the rows of one shard."""

    def __init__(self, vectors: np.ndarray, trees: int):
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.planes = directions(vectors.shape[1], trees)
        self.sorted, self.order = [], []
        for plane in self.planes:
            h = self.strings(self.unit, plane)
            order = np.argsort(h, kind="stable").astype(np.int32)
            self.sorted.append(h[order])
            self.order.append(order)

    @staticmethod
    def strings(unit: np.ndarray, plane: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ plane > 0, axis=1).view(">u8").ravel().astype(np.uint64)

    def search(self, queries: np.ndarray, k: int, surety: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, exact cosines) of the k best found for each query, best first; equal vectors are one row."""
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        strings = np.stack([self.strings(unit, p) for p in self.planes])  # tree x query
        trees = len(self.sorted)
        # how far down each tree the query's longest match goes: the better of the two sorted neighbours
        deepest = np.zeros(len(unit), np.int64)
        for t, s in enumerate(self.sorted):
            at = np.searchsorted(s, strings[t])
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(s) - 1)):
                differ = s[near] ^ strings[t]
                bits = np.where(differ == 0, BITS, BITS - 1 - np.floor(np.log2(np.maximum(differ, 1).astype(np.float64))).astype(np.int64))
                deepest = np.maximum(deepest, np.clip(bits, 0, BITS))
        out = []
        for q in range(len(unit)):
            seen = np.zeros(len(self.unit), bool)
            rows, cosines = np.empty(0, np.int64), np.empty(0)
            lo = hi = None
            for bits in range(int(deepest[q]), -1, -1):
                if bits == 0:
                    fresh = np.flatnonzero(~seen)
                else:
                    low = (strings[:, q] >> np.uint64(BITS - bits)) << np.uint64(BITS - bits)
                    high = low | np.uint64((1 << (BITS - bits)) - 1)
                    new_lo = [int(s.searchsorted(x)) for s, x in zip(self.sorted, low)]
                    new_hi = [int(s.searchsorted(x, "right")) for s, x in zip(self.sorted, high)]
                    if lo is None:
                        found = [o[a:b] for o, a, b in zip(self.order, new_lo, new_hi)]
                    else:
                        found = [part for o, a, x, y, b in zip(self.order, new_lo, lo, hi, new_hi) for part in (o[a:x], o[y:b]) if len(part)]
                    lo, hi = new_lo, new_hi
                    mark = np.zeros(len(seen), bool)
                    for part in found:
                        mark[part] = True
                    fresh = np.flatnonzero(mark & ~seen)
                seen[fresh] = True
                rows, cosines = np.concatenate([rows, fresh]), np.concatenate([cosines, self.unit[fresh] @ unit[q]])
                if len(rows) > k:
                    # of cosines that tie at the cut the earlier rows stay: rows are in the order of their smallest ids
                    near = np.flatnonzero(cosines >= np.partition(cosines, len(rows) - k)[len(rows) - k] - 1e-12)
                    best = near[np.lexsort((rows[near], -np.round(cosines[near], 12)))[:k]]
                    rows, cosines = rows[best], cosines[best]
                if bits and len(rows) == k:
                    angle = math.acos(max(-1.0, min(1.0, float(cosines.min()))))
                    if 1 - (1 - (1 - angle / math.pi) ** bits) ** trees >= surety:
                        break
            best = np.argsort(-cosines, kind="stable")
            out.append((rows[best], cosines[best]))
        return out


def nearest(vectors: DataFrame, queries, k: int = 5, trees: int = TREES, surety: float = SURETY, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that the condition `queries` (over the key) selects, the k nearest other rows found."""
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(v.isNotNull() & F.col("id").isNotNull())
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.forall(v, finite) & F.exists(v, lambda x: x != 0))
    first = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = stage(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("cid", F.element_at("ids", 1)))
    asked = rows.select(F.col("id").alias(key), "v").where(queries).select(F.col(key).alias("id"), "v").distinct().join(classes.select("v", "cid"), "v").select("id", "cid")
    asked = stage(asked)
    asking = classes.join(asked.select("cid").distinct(), "cid", "left_semi").select(F.col("cid").alias("qid"), F.col("v").alias("q"))
    total = classes.count()
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-total // (50 * QUERY_ROWS)))
    left = asking.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks).cast("long"))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = classes.select("cid", "v", "ids").withColumn("shard", F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(q: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for dim in sorted({len(x) for x in q["q"]} & {len(x) for x in own["v"]}):
            qs, rs = q[q["q"].map(len) == dim], own[own["v"].map(len) == dim].sort_values("cid")
            base, ids = np.stack(rs["v"].to_numpy()), rs["ids"].to_numpy()
            asked_for = np.stack(qs["q"].to_numpy())
            for cid, x, (found, _) in zip(qs["qid"], asked_for, Forest(base, trees).search(asked_for, k + 1, surety)):
                near = base[found]
                cosines = (near @ x) / (np.sqrt((near * near).sum(axis=1)) * math.sqrt(float(x @ x)))
                out += [(cid, int(i), float(c)) for f, c in zip(found, cosines) for i in ids[f]]
        return pd.DataFrame(out, columns=["cid", "vec_id", "score"])

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "cid long, vec_id long, score double")
    by = Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    pairs = asked.join(found, "cid").where(F.col("id") != F.col("vec_id"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of embeddings for every row whose vec_id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
