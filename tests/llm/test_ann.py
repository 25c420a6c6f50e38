import math
import random

import numpy as np
from pyspark.sql import functions as F

from txloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q, x in good.items():
        if q % 50 == 0:
            s = [(-float(x @ y / math.sqrt((x @ x) * (y @ y))), i) for i, y in good.items() if i != q and len(y) == len(x)]
            out[q] = sorted((round(a, 12), i) for a, i in s)[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(32).tolist(), 0) for i in range(3000)]
    hot = rng.standard_normal(32).tolist()
    rows += [(i, hot, 0) for i in range(3000, 4500)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, shard_rows=700).collect()
    want = brute(rows)
    assert {r["query_id"] for r in got} == set(want)
    hits = sum((round(-r["score"], 12), r["vec_id"]) in want[r["query_id"]] for r in got)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q in (3000, 4450):
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert mine == list(enumerate([i for i in range(3000, 3007) if i != q][:5], 1))


def test_odd_vectors(spark):
    random.seed(1)
    rows = [(i, [random.gauss(0, 1) for _ in range(4)], 1) for i in range(0, 120, 10)]
    odd = [(200, None, 1), (250, [0.0] * 4, 1), (300, [1.0, None, 0.0, 0.0], 1), (350, [float("nan"), 1.0, 1.0, 1.0], 1), (400, [float("inf"), 1.0, 1.0, 1.0], 1), (None, [1.0] * 4, 1), (rows[0][0], rows[0][1], 1)]
    got = ann.nearest(spark.createDataFrame(rows + odd, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    want = brute(rows)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(q, n, i) for q, s in want.items() for n, (_, i) in enumerate(s, 1)}


def test_few_and_no_rows(spark):
    one = spark.createDataFrame([(0, [1.0, 0.0], 1), (7, [1.0, 1.0], 1)], SCHEMA)
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.nearest(one, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 7, 0.707107)]
    assert ann.nearest(one.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_ties_of_unequal_vectors_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(4)
    d = rng.standard_normal(8).astype(np.float32)
    ids = rng.permutation(np.arange(1, 200)).tolist()
    rows = [(int(i), (d * np.float32(2.0 ** (n % 100 - 50))).tolist(), 0) for n, i in enumerate(ids)]
    rows += [(int(i), rng.standard_normal(8).tolist(), 0) for i in range(200, 400)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 50).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5]
