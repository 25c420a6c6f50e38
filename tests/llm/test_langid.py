import math
import random
from collections import Counter, defaultdict

import numpy as np

from txloom.llm import langid as L
from txloom.llm.common import held_out

SYLLABLES = {"aa": "ka lo mi tu re na so".split(), "bb": "schen ver lich ung ein ge".split(), "cc": "eau oir ment que les".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def plain_model(words, order):
    """Interpolated Kneser-Ney over dictionaries, by its definition."""
    padded = Counter()
    for w, n in words.items():
        padded[f" {w} "] += n
    letters = len(set("".join(padded))) + 1
    counts = {n: Counter() for n in range(1, order + 1)}
    for w, c in padded.items():
        for i in range(1, len(w)):
            for n in range(1, order + 1):
                if i - n + 1 >= 0:
                    counts[n][w[i - n + 1 : i + 1]] += c if n == order or i - n + 1 == 0 else 0
    for n in range(1, order):
        kinds = defaultdict(set)
        for w in padded:
            for i in range(n, len(w)):
                kinds[w[i - n + 1 : i + 1]].add(w[i - n])
        for g, k in kinds.items():
            counts[n][g] += len(k)
    off, total, more = {}, {}, {}
    for n in range(1, order + 1):
        ones, twos = sum(c == 1 for c in counts[n].values()), sum(c == 2 for c in counts[n].values())
        off[n] = min(0.95, ones / (ones + 2 * twos)) if ones and twos else 0.5
        total[n], more[n] = Counter(), Counter()
        for g, c in counts[n].items():
            total[n][g[:-1]] += c
            more[n][g[:-1]] += min(c, off[n])

    def p(g):
        n = len(g)
        below = p(g[1:]) if n > 1 else 1 / letters
        h = g[:-1]
        if not total[n][h]:
            return below
        return max(counts[n][g] - off[n], 0) / total[n][h] + more[n][h] / total[n][h] * below

    return lambda word: sum(math.log(p(f" {word} "[max(0, i - order + 1) : i + 1])) for i in range(1, len(word) + 2))


def test_scores_equal_the_definition():
    rng = random.Random(4)
    words = Counter(text(rng, "aa", 200).split())
    names = sorted(words)
    model = L.learn(names, np.array([words[w] for w in names]))
    want = plain_model(words, L.ORDER)
    for w in [*names[:30], "zzz", "k", "kalomitu", "xkalox"]:
        assert abs(L.word_scores(model, [w])[0] - want(w)) < 1e-6, w
    other = Counter(text(rng, "bb", 200).split())
    second = L.learn(sorted(other), np.array([other[w] for w in sorted(other)]))
    both = L.Merged([model, second]).score(["kalo", "einge", "q"])
    assert np.allclose(both[:, 0], L.word_scores(model, ["kalo", "einge", "q"])) and np.allclose(both[:, 1], L.word_scores(second, ["kalo", "einge", "q"]))


def docs(spark, n=600):
    rng = random.Random(9)
    rows = [(i, text(rng, lang, rng.randint(3, 60)), lang, "x") for i in range(n) for lang in [rng.choice(sorted(SYLLABLES))]]
    rows += [(n, None, "aa", "x"), (n + 1, "", "aa", "x"), (n + 2, "123 ... 4", "bb", "x"), (n + 3, text(rng, "cc", 50_000), None, "x"), (n + 4, "lone", None, "x"), (None, "kalo mitu", None, "x")]
    rows += [(n + 5, " ".join("".join(rng.choices("qxzwjvkpyfb", k=7)) for _ in range(60)), None, "x"), rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rejected string")


def test_held_out_accuracy_and_rejection(spark):
    d = docs(spark)
    models = L.train(d, ~held_out())
    got = L.identify(d, models).collect()
    assert len(got) == d.count()
    by = {r["doc_id"]: r for r in got}
    truth = {r["doc_id"]: r["lang"] for r in d.where("doc_id < 600").collect()}
    assert np.mean([by[i]["lang_pred"] == lang for i, lang in truth.items()]) > 0.98
    assert not any(by[i]["rejected"] for i in truth)
    assert all(by[i]["lang_pred"] == "und" and by[i]["rejected"] and by[i]["score"] == 0 for i in (600, 601, 602))
    assert by[603]["lang_pred"] == "cc" and by[605]["rejected"] and not by[None]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    d = docs(spark, 5)
    assert L.train(d.limit(0)) == {}
    assert {r["lang_pred"] for r in L.identify(d, {}).collect()} == {"und"}
    assert L.identify(d.limit(0), L.train(docs(spark, 60))).count() == 0


def test_stage_keeps_clean_rows_and_columns(spark):
    d = docs(spark)
    kept = L.keep_identified(spark, d, "")
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in d.collect()} - {r["doc_id"] for r in kept.collect()} == {600, 601, 602, 605}


def test_table_starts_anew_without_changing_results(spark, monkeypatch):
    d = docs(spark, 60)
    models = L.train(d)
    texts = [r["text"] for r in d.collect()]
    want = L.Scorer(models).judge(texts)
    monkeypatch.setattr(L, "TABLE", 30)
    small = L.Scorer(models)
    assert [small.judge([t])[0] for t in texts] == want


def test_sample_is_bounded_when_ids_repeat(spark, monkeypatch):
    rows = [(i, " ".join(["haus", "baum", "wasser", f"wort{i % 7}"] * 3), "de") for i in range(40)]
    rows += [(5, rows[5][1], "de")] * 300 + [(5, "zzz aaa", "de")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = L.train(docs, per_lang=10)
    once = L.train(docs.groupBy("doc_id", "lang").agg({"text": "min"}).withColumnRenamed("min(text)", "text"), per_lang=10)
    assert seen.keys() == once.keys() and all((seen["de"][k] == once["de"][k]).all() for k in once["de"])
