import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from txloom.llm import lm
from txloom.llm.wordhash import ordered, word_count


def brute(texts, order, leave_out):
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    grams = lambda ws: Counter(tuple(ws[i : i + k]) for k in range(1, order + 1) for i in range(len(ws) - k + 1))
    whole = sum((grams(ws) for ws in split), Counter())
    n, out = sum(map(len, split)), []
    for ws in split:
        own = grams(ws) if leave_out else Counter()
        c = lambda g: whole[g] - own[g]  # noqa: E731, B023
        s = 0.0
        for i in range(len(ws)):
            longest = min(i + 1, order)
            for k in range(longest, 0, -1):
                g = tuple(ws[i - k + 1 : i + 1])
                if k == 1:
                    p = max(1, c(g)) / max(1, n - (len(ws) if leave_out else 0))
                elif c(g):
                    p = c(g) / c(g[:-1])
                else:
                    continue
                s += math.log(p * lm.BACKOFF ** (longest - k))
                break
        out.append((len(ws), s))
    return out


def texts():
    rng = random.Random(6)
    made = [" ".join(rng.choices([f"w{i}" for i in range(12)], k=rng.randint(0, 60))) for _ in range(80)]
    return made + [None, "", "one", made[0], made[0], "x " * 3000, "ünï cödé\t日本 " * 9, "nowhere else at all", " \t\n "]


@pytest.mark.parametrize("order,leave_out,block", [(3, True, 2_000), (3, False, 2_000), (1, True, 500), (2, False, 1 << 20), (4, True, 5_000)])
def test_equals_brute_force(spark, order, leave_out, block):
    ts = texts()
    df = spark.createDataFrame([(i, t, 1, "a", 2, b"c") for i, t in enumerate(ts)] + [(None, "no id", 1, "a", 2, b"c")], "doc_id long, text string, n int, key string, block int, h binary")
    got = {r["doc_id"]: (r["n_words"], r["log_score"]) for r in lm.score(df, order=order, leave_out=leave_out, block_bytes=block).collect()}
    for i, want in enumerate(brute([*ts, "no id"], order, leave_out)[:-1]):
        assert got[i] == (want[0], pytest.approx(want[1], abs=1e-8))
    assert got[None][0] == 2
    assert lm.score(df.limit(0)).count() == 0


def test_sql_says_the_same(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts())], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(db.execute(lm.OP4_SQL).fetchall()) == sorted(map(tuple, lm.op4_lm_score(spark, str(tmp_path)).collect()))


def test_order_of_close_hashes():
    rng = np.random.default_rng(3)
    h = (rng.integers(0, 50, 4000).astype(np.uint64) << np.uint64(32)) + rng.integers(0, 9, 4000).astype(np.uint64)
    assert (ordered(h) == np.argsort(h, kind="stable")).all()
    assert len(ordered(h[:0])) == 0


def test_word_count():
    import pyarrow as pa

    ts = [None, "", "a", "b c", " d ", "", "e\x0bf", "g", " ", "ü"]
    assert word_count(pa.array(ts)) == 8 and word_count(pa.array(ts).slice(3, 4)) == 5 and word_count(pa.array([], pa.string())) == 0
