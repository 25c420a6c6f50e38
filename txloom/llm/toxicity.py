"""Toxicity by the nearest labelled examples: exact cosine of weighted TF-IDF vectors over inverted lists.

Learning uses a bounded sample: `per_class` labelled texts of each class with the smallest hash of their id. Terms are
lower-cased runs of word characters other than digits and underscores. All terms of the sample are kept; each weighs its idf times `lift`, 1 or more, by how much
commoner it is in one class. The idf counts all documents, in one pass that each task adds up. An example is the vector of a text over these terms, at unit length.

The index: blocks of alike examples, and for each term the largest weight that each block holds of it. Every text that
shares a term with an example is bounded against all blocks; blocks that could hold one of the k nearest are read, so the
k nearest are exact.

The score: votes of the k nearest weighted by their cosine, with the base rate as a fixed prior weight, then a
logistic curve that was fitted to the leave-one-out votes of the examples (so it is calibrated). Texts without any
term get the base rate of such texts. Evidence: the ids, labels and cosines of the neighbours.

Edge cases: null and empty texts have no term; with no labels (or none of one class) every score is 0; rows that
repeat a label count once, and a positive label beats a negative one; of documents that repeat an id one text (the least)
can be an example; repeated documents are scored one by one; of
equal cosines the earlier example in the order of ids as text is nearer; other columns are dropped.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txloom.llm.common import held_out, small_batches, stage, table, trim, unstage

#: Bound of the training sample, labelled texts of each class.
PER_CLASS = 2_000
K = 15
PRIOR = 1.0
ROWS = 1024
#: Examples in a block of the index, and queries asked together.
BLOCK, BATCH = 32, 128

_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def arranged(bounds: np.ndarray, numbers: np.ndarray, weights: np.ndarray, terms: int, size: int) -> np.ndarray:
    """An order of vectors in which alike ones stand together: halves by their main direction, and halves of those, down to
    `size`. It decides how tight the bounds of blocks are, never what is found."""
    done, todo = [], [np.arange(len(bounds) - 1)]
    while todo:
        ids = todo.pop()
        if len(ids) <= size:
            done.append(ids)
            continue
        lens = bounds[ids + 1] - bounds[ids]
        at = np.repeat(bounds[ids] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        t, w, rows = numbers[at], weights[at], np.repeat(np.arange(len(ids)), lens)
        u = np.cos(1.7 * np.arange(len(ids)))
        for _ in range(8):
            u = u - u.mean()
            u = np.bincount(rows, w * np.bincount(t, w * u[rows], terms)[t], len(ids))
            u = u / max(1e-30, np.abs(u).max())
        order, half = np.argsort(u, kind="stable"), -(-len(ids) // size) // 2 * size
        todo += [ids[order[half:]], ids[order[:half]]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


class BlockMaxIndex:
    """Unit vectors over term numbers in blocks of alike ones, as inverted lists: rarer terms as postings, commoner ones as a
    dense matrix for each block, with each term's largest weight in each block.

    Queries come in batches. Postings give each vector a first part of its cosine; the best of a block plus the maxima of the
    commoner terms bounds the block. The block with the largest bound is read first; those whose bound falls below its
    k-th cosine are never read. Exact: single precision only tells which vectors can be among the k nearest."""

    def __init__(self, vectors: Iterable[dict[int, float]], terms: int, size: int = BLOCK):
        numbers, weights = [np.zeros(0, np.int32)], [np.zeros(0)]
        for v in vectors:
            numbers.append(np.fromiter(v.keys(), np.int32, len(v)))
            weights.append(np.fromiter(v.values(), np.float64, len(v)))
        self.terms, self.n, self.size = terms, len(numbers) - 1, size
        bounds = np.cumsum([len(x) for x in numbers])
        self.order = arranged(bounds, np.concatenate(numbers), np.concatenate(weights), terms, size)
        self.bounds = np.concatenate([[0], np.cumsum(np.diff(bounds)[self.order])])
        self.numbers = np.concatenate([numbers[0], *[numbers[i + 1] for i in self.order.tolist()]])
        self.weights = np.concatenate([weights[0], *[weights[i + 1] for i in self.order.tolist()]])
        self.post()

    def post(self) -> None:
        count = self.count = -(-self.n // self.size)
        self.place = np.empty(self.n, np.int64)
        self.place[self.order] = np.arange(self.n)
        rows = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.bounds))
        df = np.bincount(self.numbers, minlength=self.terms)
        common = np.flatnonzero(df > max(16, self.n // 16))
        self.dense = np.full(self.terms, -1, np.int32)
        self.dense[common] = np.arange(len(common))
        at = self.dense[self.numbers]
        self.parts = np.zeros((count, len(common), self.size), np.float32)
        self.parts[rows[at >= 0] // self.size, at[at >= 0], rows[at >= 0] % self.size] = self.weights[at >= 0]
        self.maxima = np.ascontiguousarray(self.parts.max(axis=2).T) if count else np.zeros((0, 0), np.float32)
        rare = np.flatnonzero(at < 0)
        rare = rare[np.argsort(self.numbers[rare], kind="stable")]
        self.rows, self.values = rows[rare], self.weights[rare].astype(np.float32)
        self.starts = np.searchsorted(self.numbers[rare], np.arange(self.terms + 1))
        self.whole, self.read = np.zeros(self.terms), 0

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("terms", "n", "size", "order", "bounds", "numbers", "weights")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.post()

    def nearest_all(self, queries: list[dict[int, float]], k: int, without: list[int] | None = None) -> list[list[tuple[int, float]]]:
        """(vector, cosine) of the k nearest with a cosine above 0, nearest first, for each query; of equal ones the earlier."""
        if not self.n or not queries:
            return [[] for _ in queries]
        m, size = len(queries), self.size
        sides = [(np.fromiter(q.keys(), np.int64, len(q)), np.fromiter(q.values(), np.float64, len(q))) for q in queries]
        asked, sums = np.zeros((m, len(self.maxima)), np.float32), np.zeros((m, self.count * size), np.float32)
        for i, (t, w) in enumerate(sides):
            at = self.dense[t]
            asked[i, at[at >= 0]] = w[at >= 0]
            lo, hi = self.starts[t], self.starts[t + 1]
            some = np.flatnonzero(hi > lo)
            if len(some):
                spans = [slice(a, b) for a, b in zip(lo[some].tolist(), hi[some].tolist())]
                values = np.concatenate([self.values[s] for s in spans]) * np.repeat(w[some], (hi - lo)[some])
                sums[i, : self.n] = np.bincount(np.concatenate([self.rows[s] for s in spans]), values, self.n)
        mine = np.full(m, -1) if without is None else self.place[np.array(without)]
        tile = sums.reshape(m, self.count, size)
        bound = tile.max(axis=2) + asked @ self.maxima
        first, done, least = bound.argmax(axis=1), np.zeros((m, self.count), bool), np.zeros(m, np.float32)
        for turn in (0, 1):
            need = (np.arange(self.count) == first[:, None]) if turn == 0 else (bound >= np.maximum(least - 1e-4, 1e-9)[:, None]) & ~done
            for b in np.flatnonzero(need.any(axis=0)).tolist():
                q = np.flatnonzero(need[:, b])
                tile[q, b] += asked[q] @ self.parts[b]
                self.read += len(q)
            done |= need
            if turn == 0:
                if without is not None:
                    sums[np.arange(m), mine] = 0.0
                if size >= k:
                    least = np.partition(tile[np.arange(m), first], size - k, axis=1)[:, size - k]
        if without is not None:
            sums[np.arange(m), mine] = 0.0
        tile[~done] = 0.0
        floor = np.partition(sums, sums.shape[1] - k, axis=1)[:, sums.shape[1] - k] - 1e-4 if sums.shape[1] > k else np.zeros(m)
        out, whole = [], self.whole
        for i, (t, w) in enumerate(sides):
            whole[t] = w
            found = []
            for e in np.flatnonzero(sums[i, : self.n] >= max(floor[i], 1e-12)).tolist():
                a, b = self.bounds[e], self.bounds[e + 1]
                found.append((-round(float(whole[self.numbers[a:b]] @ self.weights[a:b]), 12), int(self.order[e])))
            whole[t] = 0.0
            out.append([(e, -c) for c, e in sorted(found)[:k] if c < 0])
        return out

    def nearest(self, query: dict[int, float], k: int, without: int = -1) -> list[tuple[int, float]]:
        return self.nearest_all([query], k, None if without < 0 else [without])[0]


class Votes:
    """The fitted scorer: terms, index, labels, and the curve from votes to scores."""

    def __init__(self, examples: list[tuple[object, int, np.ndarray, np.ndarray]], terms: list[str], df: np.ndarray, total: int, weight: np.ndarray, stands: tuple[float, float] = (1.0, 1.0)):
        """examples: (id, label, term numbers, counts); terms: all terms of the examples; df: documents that hold each, of
        total; weight: what each term's TF-IDF is multiplied by; stands: how many labelled documents an example of class 0
        and of class 1 stands for."""
        self.stands = np.array(stands) / min(stands)
        self.number = {t: i for i, t in enumerate(terms)}
        self.idf = ((np.log((1 + total) / (1 + df)) + 1) * weight).tolist()
        empty = [e[1] for e in examples if not len(e[2])]
        held = [e for e in examples if len(e[2])]
        self.ids, self.labels = [e[0] for e in held], np.array([e[1] for e in held], float)
        vectors = lambda: (self.vector(dict(zip(e[2].tolist(), e[3].tolist()))) for e in held)
        self.index = BlockMaxIndex(vectors(), len(self.number))
        share = lambda ys, prior, n: (self.stands[1] * sum(ys) + n * prior) / (self.stands[1] * sum(ys) + self.stands[0] * (len(ys) - sum(ys)) + n)
        self.base = share([e[1] for e in examples], 0.5, 1.0)
        self.blank = share(empty, self.base, 0.5)
        self.curve = (1.0, 0.0)
        if held:
            x, own = [], vectors()
            for at in range(0, len(held), BATCH):
                part = list(islice(own, BATCH))
                x += [self.vote(near) for near in self.index.nearest_all(part, K, list(range(at, at + len(part))))]
            x = np.array(x)
            self.curve = logistic(np.log(x / (1 - x)), self.labels, self.stands[self.labels.astype(int)])

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        v = {t: (1 + math.log(n)) * self.idf[t] for t, n in sorted(counts.items())}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    def vote(self, near: list[tuple[int, float]]) -> float:
        votes = np.zeros(2)
        for i, c in near:
            y = int(self.labels[i])
            votes[y] += c * self.stands[y]
        return (votes[1] + PRIOR * self.base) / (votes.sum() + PRIOR)

    def score(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, float]]]]:
        number, (a, b), out = self.number, self.curve, []
        for at in range(0, len(texts), BATCH):
            counts = [Counter([number[w] for w in words_of(t or "") if w in number]) for t in texts[at : at + BATCH]]
            nears = iter(self.index.nearest_all([self.vector(c) for c in counts if c], K))
            for c in counts:
                if not c:
                    out.append((self.blank, []))
                    continue
                near = next(nears)
                vote = self.vote(near)
                out.append((1 / (1 + math.exp(-(a * math.log(vote / (1 - vote)) + b))), near))
        return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge; slope 1 and intercept 0 if one class is missing."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    X, w = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        step = np.linalg.solve((X * (weight * p * (1 - p))[:, None]).T @ X + 1e-2 * np.eye(2), X.T @ (weight * (p - y)) + 1e-2 * (w - [1.0, 0.0]))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def lift(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Weight of each term by how much commoner it is in one class than in the other: 1 where it is alike in both."""
    ratio = np.log2(((pos + 1) / (n_pos + 2)) / ((neg + 1) / (n_neg + 2)))
    return 1 + np.abs(ratio) * (1 - 1 / np.sqrt(1 + pos + neg))


def train(docs: DataFrame, labels: DataFrame, allowed=None, per_class: int = PER_CLASS) -> Votes | None:
    """The scorer, or None if a class has no text. The driver gets the term counts of at most 2 per_class texts,
    and how many of all documents hold each term of those."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if allowed is not None:
        marks = marks.where(allowed)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    whole = dict(marks.groupBy("toxic").count().collect())
    # about four times the sample by hash, so that ranking meets a bounded number of rows; then exactly the smallest
    spread, each = 1 << 40, [max(1, whole.get(y, 0)) for y in (0, 1)]
    cut = F.when(F.col("toxic") == 1, min(spread, 4 * per_class * spread // each[1])).otherwise(min(spread, 4 * per_class * spread // each[0]))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(spread))
    drawn = sorted(marks.where(place < cut).select("toxic", place.alias("place"), "doc_id").collect(), key=lambda r: (r["toxic"], r["place"], str(r["doc_id"])))
    few = [r for y in (0, 1) for r in [r for r in drawn if r["toxic"] == y][:per_class]]
    if not few:
        return None
    # at most 2 per_class rows: small enough to send to every task; one text an id
    few = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in few], T.StructType([marks.schema["doc_id"], T.StructField("toxic", T.IntegerType())]))
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    sample = stage(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))

    sizes = dict(sample.groupBy("toxic").count().collect())
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        unstage(sample)
        return None

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Counter(words_of(t or "")) for t in batch.column(2).to_pylist()]
            packed = [pa.array([" ".join(c) for c in made], pa.string()), pa.array([np.fromiter(c.values(), np.int32, len(c)).tobytes() for c in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], ["doc_id", "toxic", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", F.col("toxic").cast("int"), "text").mapInArrow(counts, f"doc_id {kind}, toxic int, terms string, counts binary")
    number: dict[str, int] = {}
    examples = []
    for r in rows.toLocalIterator():
        own = np.array([number.setdefault(t, len(number)) for t in r["terms"].split()], np.int32)
        examples.append((r["doc_id"], int(r["toxic"] > 0), own, np.frombuffer(bytes(r["counts"]), np.int32)))
    examples.sort(key=lambda e: (str(e[0]), e[1]))
    terms = sorted(number)
    new = np.zeros(len(terms), np.int32)
    new[[number[t] for t in terms]] = np.arange(len(terms))
    del number
    examples = [(i, y, new[own], n) for i, y, own, n in examples]
    a, b = (np.bincount(np.concatenate([e[2] for e in examples if e[1] == y]), minlength=len(terms)) for y in (1, 0))
    unstage(sample)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n, total = {t: i for i, t in enumerate(terms)}, np.zeros(len(terms), np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for text in batch.column(0).to_pylist():
                n[[number[w] for w in set(words_of(text or "")) if w in number]] += 1
        at = np.flatnonzero(n)
        del number
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(n[at], total), pa.int64())], ["term", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(held, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = found.column("term").to_numpy(), found.column("n").to_numpy()
    df = np.zeros(len(terms), np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return Votes(examples, terms, df, int(n[at < 0].sum()), lift(a, b, pos, neg), (max(1.0, whole[0] / neg), max(1.0, whole[1] / pos)))


def score(docs: DataFrame, model: Votes | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1), evidence (neighbours: id, label, cosine) for each row."""
    kind = docs.schema[key].dataType.simpleString()
    near = f"array<struct<id:{kind},label:int,cosine:double>>"
    if model is None:
        return docs.select(F.col(key), F.lit(0.0).alias("score"), F.array().cast(near).alias("evidence"))
    blob = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = pickle.loads(blob)  # a task's own: a worker keeps nothing for later stages
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = votes.score(part.column(1).to_pylist())
                seen = [[{"id": votes.ids[i], "label": int(votes.labels[i]), "cosine": c} for i, c in n] for _, n in made]
                own = pa.list_(pa.struct([("id", batch.column(0).type), ("label", pa.int32()), ("cosine", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.float64()), pa.array(seen, own)], ["key", "score", "evidence"])

    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, score double, evidence {near}")
    return out.withColumnRenamed("key", key)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    made = score(docs, train(docs, table(spark, sf_dir, "labels"), ~held_out()))
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score below one half, with all their columns."""
    small_batches(spark)
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    if model is None:
        return docs
    blob = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = pickle.loads(blob)  # a task's own: a worker keeps nothing for later stages
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                yield part.filter(pa.array([m[0] < 0.5 for m in votes.score(texts)], pa.bool_()))
        del votes
        trim()

    return docs.mapInArrow(run, docs.schema)
