import math
import random
from collections import Counter

import numpy as np
import pytest

from txloom.llm import toxicity as T
from txloom.llm.common import held_out


@pytest.mark.parametrize(("n", "terms", "size"), [(400, 30, 32), (400, 300, 32), (90, 30, 8), (10, 20, 32), (400, 2000, 16)])
def test_index_is_exact(n, terms, size):
    rng = random.Random(5)
    vectors = []
    for _ in range(n):
        v = {t: rng.random() + 0.1 for t in rng.sample(range(terms), rng.randint(1, 6))}
        n = sum(w * w for w in v.values()) ** 0.5
        vectors.append({t: w / n for t, w in v.items()})
    index = T.BlockMaxIndex(vectors, terms, size)
    for q in vectors[:60]:
        cosines = [(-round(sum(w * v.get(t, 0.0) for t, w in q.items()), 12), i) for i, v in enumerate(vectors)]
        want = sorted(c for c in cosines if c[0] < 0)[: T.K]
        assert [(-c, i) for i, c in index.nearest(q, T.K)] == want
    own = index.nearest(vectors[7], T.K, without=7)
    assert 7 not in [i for i, _ in own]
    assert T.BlockMaxIndex([], 5).nearest({1: 1.0}, 3) == [] and index.nearest_all([], 3) == []


def test_blocks_of_other_themes_are_not_read():
    rng = random.Random(5)
    vectors = []
    for i in range(1024):
        v = {t + 40 * (i % 4): rng.random() + 0.1 for t in rng.sample(range(40), 12)}
        n = sum(w * w for w in v.values()) ** 0.5
        vectors.append({t: w / n for t, w in v.items()})
    index = T.BlockMaxIndex(vectors, 160)
    index.nearest_all(vectors[:64], T.K)
    assert index.read < 64 * index.count / 2


def data(spark, n=900):
    rng = random.Random(2)
    plain, rude = [f"w{i}" for i in range(400)], ["idiot", "scum", "moron", "trash"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=40)
        bad = i % 5 == 0
        if bad:
            words[3:5] = rng.sample(rude, 2)
        docs.append((i, " ".join(words).upper() if i % 7 == 0 else ", ".join(words), "en"))
        labels.append((i, 1, int(bad)))
    docs += [(n, None, "en"), (n + 1, "", "en"), (n + 2, "idiot " * 20_000, "en"), (0, docs[0][1], "en"), (None, "x", "en")]
    labels += [(0, 1, 1), (None, 1, 1), (1, 1, None), (n + 9, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_evidence(spark):
    docs, labels = data(spark)
    model = T.train(docs, labels, ~held_out())
    got = T.score(docs, model).withColumn("held", held_out()).collect()
    assert len(got) == docs.count()
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in got if r["held"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert np.mean(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    long = next(r for r in got if r["doc_id"] == 902)
    assert long["score"] > 0.5 and len(long["evidence"]) == T.K and all(e["label"] in (0, 1) and e["cosine"] > 0 for e in long["evidence"])
    assert next(r for r in got if r["doc_id"] == 900)["evidence"] == []


def test_nothing_to_learn_from(spark):
    docs, labels = data(spark, 20)
    for l in (labels.limit(0), labels.where("toxic = 0")):
        assert T.train(docs, l) is None
    assert {r["score"] for r in T.score(docs, None).collect()} == {0.0}
    assert T.score(docs.limit(0), T.train(*data(spark))).count() == 0


def test_stage_keeps_columns_and_clean_rows(spark, tmp_path):
    docs, labels = data(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = T.keep_clean(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len([i for i in ids if i is not None and i < 900 and i % 5]) == 720
    assert len([i for i in ids if i is not None and i < 900 and not i % 5]) < 10


def test_every_shared_term_finds_neighbours(spark):
    """A text that holds no term typical of a class still meets the examples that share its only known word."""
    docs, labels = data(spark)
    asked = spark.createDataFrame([(5000, "w7"), (5001, "unheard of")], "doc_id long, text string")
    got = {r["doc_id"]: r["evidence"] for r in T.score(asked, T.train(docs, labels, ~held_out())).collect()}
    assert len(got[5000]) == T.K and all(e["cosine"] > 0 for e in got[5000]) and got[5001] == []


def test_idf_counts_all_documents(spark):
    docs, labels = data(spark, 100)
    more = docs.unionByName(spark.createDataFrame([(9000 + i, "w7 idiot", "en") for i in range(50)], docs.schema))
    want, got = [], []
    for d in (docs, more):
        model, rows = T.train(d, labels), [set(T.words_of(r["text"] or "")) for r in d.collect()]
        for t in ("w", "idiot", "scum"):
            want.append(np.log((1 + len(rows)) / (1 + sum(t in r for r in rows))) + 1)
            got.append(model.idf[model.number[t]])
    assert np.allclose(np.divide(got[3:], got[:3]), np.divide(want[3:], want[:3])) and got[4] < got[1]


def test_score_is_that_of_brute_force(spark):
    """Idf over all documents, lift, unit vectors, k nearest by cosine, votes, curve: all again from their definitions."""
    docs, labels = data(spark, 200)
    rows = [r["text"] or "" for r in docs.collect()]
    made = {r["doc_id"]: (r["score"], [(e["id"], round(e["cosine"], 9)) for e in r["evidence"]]) for r in T.score(docs.where("doc_id < 200"), T.train(docs, labels)).collect()}
    marks = {}
    for r in labels.where("toxic is not null and doc_id is not null").collect():
        marks[r["doc_id"]] = max(marks.get(r["doc_id"], 0), r["toxic"])
    texts = {i: min(r["text"] or "" for r in docs.where(f"doc_id = {i}").collect()) for i in (0, 1)} | {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id > 1").collect()}
    counts = {i: Counter(T.words_of(texts[i])) for i in marks if i in texts}
    terms = sorted({t for c in counts.values() for t in c})
    df = {t: 0 for t in terms}
    for r in rows:
        for t in set(T.words_of(r)) & df.keys():
            df[t] += 1
    pos, neg = ([c for i, c in counts.items() if marks[i] == y] for y in (1, 0))
    weight = {}
    for t in terms:
        a, b = sum(t in c for c in pos), sum(t in c for c in neg)
        ratio = math.log2(((a + 1) / (len(pos) + 2)) / ((b + 1) / (len(neg) + 2)))
        weight[t] = (math.log((1 + len(rows)) / (1 + df[t])) + 1) * (1 + abs(ratio) * (1 - 1 / math.sqrt(1 + a + b)))

    def vector(c):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in c.items() if t in weight}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    examples = {i: vector(c) for i, c in counts.items() if c}
    stands = [max(1, sum(m == y for m in marks.values()) / len(x)) for y, x in ((0, neg), (1, pos))]
    stands = [x / min(stands) for x in stands]
    weighed = [stands[1] * len(pos), stands[0] * len(neg)]
    base = (weighed[0] + 0.5) / (sum(weighed) + 1)

    def near(v, without=None):
        found = [(-round(sum(w * e.get(t, 0.0) for t, w in v.items()), 12), str(i), i) for i, e in examples.items() if i != without]
        return [(i, -c) for c, _, i in sorted(found)[: T.K] if c < 0]

    def vote(ns):
        votes = [sum(c * stands[y] for i, c in ns if marks[i] == y) for y in (0, 1)]
        return (votes[1] + T.PRIOR * base) / (sum(votes) + T.PRIOR)

    ids = sorted(examples, key=str)
    x = np.array([vote(near(examples[i], i)) for i in ids])
    a, b = T.logistic(np.log(x / (1 - x)), np.array([float(marks[i]) for i in ids]), np.array([stands[marks[i]] for i in ids]))
    for i in range(2, 200):
        ns = near(vector(Counter(T.words_of(texts[i]))))
        p = vote(ns)
        assert made[i][1] == [(j, round(c, 9)) for j, c in ns]
        assert made[i][0] == pytest.approx(1 / (1 + math.exp(-(a * math.log(p / (1 - p)) + b))), abs=1e-6)


def test_sample_is_bounded_when_ids_repeat(spark):
    docs, labels = data(spark, 60)
    many = docs.unionByName(docs.where("doc_id = 5").crossJoin(spark.range(500)).select(*docs.columns))
    model = T.train(many.unionByName(docs), labels, per_class=10)
    assert len(model.ids) == len(set(model.ids)) <= 20
