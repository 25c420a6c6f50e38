"""Hard negatives against all pairs, whatever the sizes of shards, blocks and buckets."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from txloom.llm import hardneg, registry

KIND = "vec_id long, label int, embedding array<float>, id string, rank string"


def plain(rows, every=5, positives=5, negatives=3):
    """All pairs, one by one."""
    good = {(k, c, tuple(math.floor(256 * x) for x in v)) for k, c, v, *_ in rows if k is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    good = {k: (c, v) for k, c, v in sorted(good, reverse=True)}  # of rows that share an id the smallest
    good = {(k, c, v) for k, (c, v) in good.items()}
    out = []
    for k, c, v in good:
        if k % every:
            continue
        others = [(-sum(x * y for x, y in zip(v, w)), j, d) for j, d, w in good if j != k and len(w) == len(v)]
        for s, j, _ in sorted(o for o in others if o[2] == c)[:positives]:
            fits = sorted((t, i) for t, i, d in others if d != c and 50 * -s <= 100 * -t <= 95 * -s)[:negatives]
            out += [(k, j, n, i, -s, -t) for n, (t, i) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, KIND)
    return sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 5 == 0, F.col("label"), **options).collect())


def vectors(n, seed, dim=6, labels=3):
    rng = random.Random(seed)
    return [(k, rng.randrange(labels), [rng.gauss(0.3, 1) * (1 + k % 4) for _ in range(dim)], "x", "y") for k in range(n)]


@pytest.mark.parametrize("shard,block,bucket", [(15, 12, 512), (3, 2, 3)])
def test_all_pairs(spark, monkeypatch, shard, block, bucket):
    monkeypatch.setattr(hardneg, "SHARD_BITS", shard)
    monkeypatch.setattr(hardneg, "BLOCK_BITS", block)
    monkeypatch.setattr(hardneg, "BUCKET", bucket)
    rows = vectors(120, 1)
    rows = [(k, c, [float(round(x, 6)) for x in v], a, b) for k, c, v, a, b in rows]
    df = [(k, c, [float(x) for x in spark_float(v)], a, b) for k, c, v, a, b in rows]
    got = mined(spark, df)
    assert got == plain(df) and len(got) > 100


def spark_float(v):
    import numpy as np

    return np.array(v, np.float32).tolist()


def test_ties_copies_and_odd_rows(spark):
    one, two = [1.0, 0.5], [0.75, 0.25]
    rows = [(k, k % 2, one if k % 3 else two, "", "") for k in range(40)]  # hot classes, all scores tie
    rows += [rows[5], rows[5], rows[10]]  # repeated rows
    rows += [(5, 1, [0.25, 0.75], "", ""), (200, 0, [0.0, 0.0], "", ""), (205, 1, [-1.0, -1.0], "", ""), (210, 0, [1.0, 2.0, 3.0], "", ""), (211, 0, [1.0, 2.0, 3.0], "", ""), (212, 1, [0.5, 1.0, 1.5], "", "")]
    odd = [(None, 1, one, "", ""), (300, None, one, "", ""), (305, 1, None, "", ""), (310, 1, [1.0, None], "", ""), (315, 1, [1.0, float("nan")], "", ""), (320, 1, [float("inf"), 1.0], "", ""), (325, 1, [], "", "")]
    want = plain(rows + [odd[-1]])
    assert mined(spark, rows + odd) == want and len(want) > 50
    assert mined(spark, []) == []
    assert mined(spark, rows[:1]) == []


def test_large_numbers_stay_exact(spark):
    rows = [(k, k % 2, spark_float([1e6 + k * 64.0, 3e5 * (k % 7), float(k)]), "", "") for k in range(60)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, [*rows, (1000, 0, [1e30, 1.0, 1.0], "", "")]) == plain(rows)  # beyond 64-bit scores


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = c.sql(hardneg.OP13_SQL)
    got = registry.QUERIES["op13_hard_negatives"](spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_buckets_are_pruned():
    """Of buckets whose norms cannot reach the window none is scored."""
    import numpy as np
    import pyarrow as pa

    n = hardneg.BUCKET * 4
    x = [[n - k, 0] for k in range(n)]
    rows = pa.table({"norm2": [v[0] ** 2 for v in x], "ids": [[k] for k in range(n)], "q": pa.array(x, pa.list_(pa.int32())), "label": [1] * n})
    shard = hardneg.Shard(rows, 2)
    seen = []
    shard.label = Spy(shard.label, seen)
    one = lambda v: np.array([v], np.int64)
    win, cls, score = shard.visit(np.array([[2, 0]]), one(1), one(0), one(2 * (n - 5)), one(hardneg.HIGHEST), one(hardneg.LOWEST), 10, True)
    assert score.tolist() == [2 * (n - k) for k in range(6)] and len(seen) == 1


class Spy:
    def __init__(self, inner, seen):
        self.inner, self.seen = inner, seen

    def __getitem__(self, at):
        self.seen.append(at)
        return self.inner[at]
