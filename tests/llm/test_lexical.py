"""Ranked search against a score of every document, whatever the order, the clusters and the blocks."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from txloom.llm import lexical, registry

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    held = [(i, Counter(t)) for i, x in docs if (t := terms(x))]
    if not held:
        return []
    n_docs, words = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 90 + (90 * c.total() * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, n, None if null else i, -s) for n, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, "a", "b") for i, t in docs], "doc_id long, text string, rank string, group string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in lexical.search(lexical.build(d), q, k).collect()), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["Été", "straße", "x_y", "naïve", "日本"]
    topics = [rng.sample(words, 40) for _ in range(6)]
    made = [(k, " ".join(rng.choices(topics[k % 6], k=rng.randrange(1, 60)) + rng.choices(words, k=rng.randrange(6)))) for k in range(n)]
    return made, [(k, " ".join(rng.sample(topics[k % 6], 5) + rng.sample(words, 2))) for k in range(12)]


@pytest.mark.parametrize("group,items", [(3_000_000, 2_000), (400, 3)])
def test_every_document(spark, monkeypatch, group, items):
    monkeypatch.setattr(lexical, "ITEMS", items)
    monkeypatch.setattr(lexical, "GROUP_WORDS", group)
    own, asked = corpus(400, 3)
    got = searched(spark, own, asked)
    assert got == plain(own, asked) and len(got) > 100


def test_ties_copies_and_odd_texts(spark):
    docs = [(k, "same words here") for k in range(30, 0, -1)] + [(None, "same words here"), (7, "same words here")]
    docs += [(100, None), (101, ""), (102, "... --- ["), (103, "A" * 5000 + " here"), (104, "HERE É"), (105, "été É"), (106, "here " * 3000)]
    items = [(1, "Words HERE here"), (2, None), (3, ""), (4, "unknown"), (5, "É"), (1, "Words HERE here"), (None, "été"), (6, "A" * 5000)]
    want = plain(docs, items)
    assert searched(spark, docs, items) == want and len(want) > 20
    assert searched(spark, docs, items, 40) == plain(docs, items, 40)
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == [] and searched(spark, [(1, None)], items) == []


def test_bisection_brings_alike_documents_together():
    """Documents of two kinds, shuffled: each half holds one kind, and every document is kept."""
    rng = np.random.default_rng(1)
    kind = rng.permutation(np.repeat([0, 1], 128))
    doc = np.repeat(np.arange(256), 12)
    term = rng.integers(0, 40, len(doc)) + 1000 * kind[doc]
    order = lexical.bisected(doc, term.astype(np.uint64), np.arange(256), 128)
    assert sorted(order) == list(range(256)) and {kind[order[:128]].mean(), kind[order[128:]].mean()} == {0.0, 1.0}
    tree = lexical.Tree(doc, term.astype(np.uint64), 256, 1)
    leaf = tree.leaves(doc, term.astype(np.uint64), 256)
    assert max((leaf == kind).mean(), (leaf != kind).mean()) == 1.0


def test_clusters_are_passed_over():
    """A cluster whose bound is below the k-th score is not scored; one that equals it is."""
    ids = pa.array(range(512), pa.int64())
    doc, term = np.arange(512), np.full(512, 5, np.uint64)
    worth = np.where(np.arange(512) < 256, 9, 3)
    rows = [b.to_pylist()[0] for b in lexical.clusters(ids, doc, term, worth, np.arange(512))]
    block = lexical.Block([np.array([5], np.uint64), np.array([6], np.uint64)])
    block.weight[:] = 2
    assert [block.bounds(r).tolist() for r in rows] == [[18, 0], [6, 0]]
    assert block.scores(rows[1], np.array([0])).tolist() == [[6] * 256]
    best = lexical.Best(block, 10)
    best.add(np.array([0]), block.scores(rows[0], np.array([0])), rows[0]["doc_ids"])
    assert best.floor.tolist() == [18, 1] and best.rows().column(1).to_pylist() == list(range(10))


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.sql(lexical.OP12_SQL)
    got = registry.QUERIES["op12_lexical_search"](spark, sf)
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and len(rows) > 100
