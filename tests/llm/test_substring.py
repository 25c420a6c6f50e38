import random
import re
from collections import Counter

import pytest

from txloom.llm import substring as D


def brute(texts, window):
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("period", [1, 2, 7, 13, 21, 31])
def test_difference_cover(period):
    cover = D.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(cover) < period or period < 4


def corpus(rng, n, vocabulary=50, longest=120):
    words = [f"w{i}" for i in range(vocabulary)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, longest))) for _ in range(n)]
    passage = " ".join(rng.choices(words, k=50))
    for i in range(0, n, 3):
        w = texts[i].split()
        at = rng.randint(0, len(w))
        texts[i] = " ".join([*w[:at], passage, *w[at:]])
    return texts


@pytest.mark.parametrize(("seed", "window", "period"), [(1, 35, 13), (2, 8, 7), (3, 5, 3), (4, 35, 21)])
def test_equals_brute_force(spark, monkeypatch, seed, window, period):
    monkeypatch.setattr(D, "BLOCK_BYTES", 4_000)
    rng = random.Random(seed)
    texts = corpus(rng, 60, vocabulary=5 if window < 10 else 50)
    texts += [None, "", "one", texts[0], texts[0], " a b c\x1cd\te\x0bf\r\ng " * 10, "x " * 3000, "ünï cödé 日本 " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in D.dedup_rows(df, window, period).collect()}
    assert got == dict(enumerate(brute(texts, window)))


def test_spans_repeated_rows_and_other_columns(spark):
    words = [f"v{i}" for i in range(40)]
    rows = [(1, "a b " + " ".join(words) + " c", "q", 7), (2, " ".join(words) + " z", None, None), (None, "p q", "r", 1), (3, "s " * 34, "t", 2), (3, "s " * 34, "t", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, block int")
    got = D.dedup_rows(df).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["kept"], [tuple(s) for s in r["spans"]], r["block"]) for r in got] == [
        (None, "p q", [], 1), (1, "a b c", [(2, 40)], 7), (2, "z", [(0, 40)], None), (3, " ".join(["s"] * 34), [], 2), (3, " ".join(["s"] * 34), [], 2),
    ]
    assert D.dedup_rows(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        D.dedup_rows(df, 5, 7)


def test_stage_leaves_other_texts_as_they_are(spark):
    words = " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"a  {words}\n", "en", "s", 1), (2, f"{words} b", "en", "s", 2), (3, "kept  as\tis", "en", "s", 11), (4, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = D.cut_repeats(spark, df, "")
    assert kept.columns == df.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()} == {1: ("a", 1), 2: ("b", 1), 3: ("kept  as\tis", 11), 4: (None, None)}
