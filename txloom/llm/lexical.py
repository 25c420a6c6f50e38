"""Ranked lexical search over an index whose documents are ordered by recursive graph bisection.

Build. Documents are vectors of term hashes. Recursive graph bisection halves a set of documents again and again, swapping
those pairs that lower the cost of the gaps in the posting lists, so documents that share terms end up side by side. Its
upper levels are fitted on a bounded sample (`SAMPLE` documents, `SKETCH` terms of each), and every document descends them
by the same cost; the lower levels run exactly, in a group of documents that one task holds. Runs of `CLUSTER` documents of
the final order are the clusters: a row each, with its posting lists and, for each term, the largest impact in it.

Search. A cluster's bound for an item is the sum of weight times largest impact over the item's terms: no document in it
scores more. Each task visits its clusters by bound and stops where no bound reaches the item's k-th score. A first round
visits the best cluster of each batch only; the k-th scores that it finds bound the second round everywhere. Both are exact:
a cluster whose bound equals the k-th score is visited, so ties go to the smaller doc_id.

Items are a stated set and are taken in blocks of bounded size (`ITEMS`, `TERMS`); for each block the index is read anew.

Scale: the driver sees the sample, a count for each leaf of the fitted tree, and the terms of one block of items. Leaves are
split into groups by the words that they hold, so a leaf with a third of all documents is many groups. Text never moves:
only vectors are shuffled, once. 64-bit hashes stand for terms.

Edge cases: a null or empty text has no terms and is never found; null doc_ids count, and come after others of the same
score; a row that repeats is another document; an item that repeats is answered once for each row; items without terms, or
whose terms no document holds, give no rows; empty tables give none; other columns are dropped.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txloom.llm import wordhash
from txloom.llm.common import shared_dir, stage, table, unstage

#: The sample that the upper levels are fitted on, terms taken of each document, and how many levels.
SAMPLE, SKETCH, DEPTH = 4_096, 64, 6
#: Words in a group of documents that one task orders, at most (but for a single longer document).
GROUP_WORDS = 3_000_000
CLUSTER, TURNS = 256, 4
#: Items, and terms of items, in one block.
ITEMS, TERMS = 2_000, 200_000
#: Bytes of a row group of the index: what a reader holds at a time.
ROW_GROUP = 8 << 20

#: Bytes between terms: ASCII but for letters and digits.
BETWEEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
NODE = np.uint64(0x9E3779B97F4A7C15)


class Vectors:
    """Documents as rows of (term, count), in one flat array."""

    def __init__(self, row: np.ndarray, n: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray):
        self.row, self.n, self.at, self.term, self.tf = row, n, at, term, tf


def vectors(texts: pa.Array) -> Iterator[Vectors]:
    """The vectors of consecutive rows; terms ascend within a document."""
    for first, h, own in wordhash.slices(texts, True, BETWEEN):
        n = np.diff(own)
        doc = np.repeat(np.arange(len(n)), n)
        order = wordhash.ordered(h)
        order = order[np.argsort(doc[order].astype(np.uint16 if len(n) < 1 << 16 else np.int64), kind="stable")]
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(new)
        yield Vectors(np.arange(first, first + len(n)), n, np.searchsorted(doc[starts], np.arange(len(n) + 1)), h[starts], np.diff(np.append(starts, len(h))))


def gaps(d: np.ndarray, n: int) -> np.ndarray:
    """What the gaps of a posting list cost that has d of n documents."""
    return d * np.log2(n / (d + 1))


def halves(doc: np.ndarray, term: np.ndarray, n: int, terms: int) -> np.ndarray:
    """For documents 0..n-1 in their present order, True for those that belong in the second half."""
    second = np.arange(n) >= (n + 1) // 2
    sizes = int((~second).sum()), int(second.sum())
    for _ in range(TURNS):
        where = second[doc]
        right = np.bincount(term[where], minlength=terms).astype(np.float64)
        left = np.bincount(term, minlength=terms) - right
        now = gaps(left, sizes[0]) + gaps(right, sizes[1])
        leave = now - gaps(np.maximum(left - 1, 0), sizes[0]) - gaps(right + 1, sizes[1])
        come = now - gaps(left + 1, sizes[0]) - gaps(np.maximum(right - 1, 0), sizes[1])
        gain = np.bincount(doc, np.where(where, come[term], leave[term]), minlength=n)
        a, b = np.flatnonzero(~second), np.flatnonzero(second)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        swap = int((gain[a[:m]] + gain[b[:m]] > 1e-9).sum())
        if not swap:
            break
        second[a[:swap]], second[b[:swap]] = True, False
    return second


def bisected(doc: np.ndarray, term: np.ndarray, docs: np.ndarray, least: int) -> np.ndarray:
    """The documents in the order of recursive bisection. doc (places in docs, ascending) and term: all postings."""
    if len(docs) <= least:
        return docs
    _, term, count = np.unique(term, return_inverse=True, return_counts=True)
    shared = (count > 1) & (count < len(docs))  # a term of one document, or of all, tells nothing
    keep = shared[term]
    doc, term = doc[keep], (np.cumsum(shared) - 1)[term[keep]]
    second = halves(doc, term, len(docs), int(shared.sum()))
    out = []
    for side in (~second, second):
        place, mine = np.cumsum(side) - 1, side[doc]
        out.append(bisected(place[doc[mine]], term[mine], docs[side], least))
    return np.concatenate(out)


class Tree:
    """The fitted upper levels: at each node, how much a term draws a document to the first half."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, n: int, depth: int):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        held = [(doc, term, n)]
        for _ in range(depth):
            keys, weights, below = [], [], []
            for node, (doc, term, n) in enumerate(held):
                if n < 32:
                    below += [(doc[:0], term[:0], 0)] * 2
                    continue
                found, at, count = np.unique(term, return_inverse=True, return_counts=True)
                second = halves(doc, at, n, len(found))
                right = np.bincount(at[second[doc]], minlength=len(found))
                left, sizes = count - right, ((~second).sum(), second.sum())
                draw = np.log((left + 1) / (sizes[0] + 2)) - np.log((right + 1) / (sizes[1] + 2))
                known = count > 1
                keys.append(self._key(found[known], np.full(int(known.sum()), node)))
                weights.append(draw[known].astype(np.float32))
                for side in (~second, second):
                    place, mine = np.cumsum(side) - 1, side[doc]
                    below.append((place[doc[mine]], term[mine], int(side.sum())))
            key, weight = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((keys, np.uint64), (weights, np.float32)))
            order = np.argsort(key)
            self.levels.append((key[order], weight[order]))
            held = below

    @staticmethod
    def _key(term: np.ndarray, node: np.ndarray) -> np.ndarray:
        return wordhash.mixed(term ^ (node.astype(np.uint64) * NODE))

    def leaves(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """The leaf of each document 0..n-1."""
        node = np.zeros(n, np.int64)
        for keys, weights in self.levels:
            pull = np.zeros(n)
            if len(keys):
                own = self._key(term, node[doc])
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                pull = np.bincount(doc, np.where(keys[at] == own, weights[at], 0), minlength=n)
            node = node * 2 + (pull < 0)
        return node


def sketched(v: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of the terms with the smallest hashes of each document."""
    sizes = np.minimum(np.diff(v.at), SKETCH)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return doc, v.term[np.repeat(v.at[:-1] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


def fitted(docs: DataFrame, text: str, total: int) -> Tree:
    """The upper levels, from a sample of about SAMPLE documents (2 * SAMPLE at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v in vectors(batch.column(0)):
                doc, term = sketched(v)
                cut = np.searchsorted(doc, np.arange(len(v.n) + 1))
                yield pa.RecordBatch.from_arrays([pa.array([term[a:b].tobytes() for a, b in zip(cut, cut[1:]) if a < b], pa.binary())], ["terms"])

    some = docs.select(F.col(text).cast("string")).where(F.rand(11) < min(1.0, SAMPLE / max(1, total)))
    got = [np.frombuffer(r["terms"], np.uint64) for r in some.mapInArrow(run, "terms binary").limit(2 * SAMPLE).collect()]
    doc = np.repeat(np.arange(len(got)), list(map(len, got)))
    return Tree(doc, np.concatenate([np.empty(0, np.uint64), *got]), len(got), DEPTH)


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 8 * m) with m = 10 + (90 * n * docs) div words."""
    if 90 * int(n.max(initial=0)) * docs < 1 << 63:
        m = 10 + 90 * n.astype(np.int64) * docs // words
    else:
        m = np.array([10 + 90 * int(x) * docs // words for x in n], np.int64)
    return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 8 * m)


CLUSTER_KIND = "doc_ids array<long>, terms binary, dfs binary, tops binary, places binary, impacts binary"


def clusters(ids: pa.Array, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, order: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a group of documents in their final order. places: the documents of each posting list, in the cluster."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = rank[doc]
    sort = np.lexsort((at, term, at // CLUSTER))
    at, term, impact = at[sort], term[sort], impact[sort]
    edges = np.searchsorted(at // CLUSTER, np.arange(-(-len(order) // CLUSTER) + 1))
    names = [x.partition(" ")[0] for x in CLUSTER_KIND.split(", ")]
    for c, (a, b) in enumerate(zip(edges, edges[1:])):
        t, place, worth = term[a:b], at[a:b] - c * CLUSTER, impact[a:b]
        starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        cols = [t[starts], np.diff(np.append(starts, b - a)).astype("<i4"), np.maximum.reduceat(worth, starts).astype("<i4"), place.astype("u1"), worth.astype("<i4")]
        own = ids.take(pa.array(order[c * CLUSTER : (c + 1) * CLUSTER]))
        yield pa.RecordBatch.from_arrays([pa.array([own.to_pylist()], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in cols]], names)


class Index:
    """The clusters (a table in the shared folder), how many documents have terms, and how many terms they have in all."""

    def __init__(self, rows: DataFrame, docs: int, words: int):
        self.rows, self.docs, self.words = rows, docs, words


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tree = spark.sparkContext.broadcast(fitted(docs, text, docs.count()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_of, words_of = np.zeros(1 << DEPTH, np.int64), np.zeros(1 << DEPTH, np.int64)
        for batch in batches:
            for v in vectors(batch.column(0)):
                some = v.n > 0
                leaf = tree.value.leaves(*sketched(v), len(v.n))[some]
                docs_of += np.bincount(leaf, minlength=1 << DEPTH)
                words_of += np.bincount(leaf, v.n[some], minlength=1 << DEPTH).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << DEPTH)), pa.array(docs_of), pa.array(words_of)], ["leaf", "docs", "words"])

    sizes = rows.select("text").mapInArrow(count, "leaf long, docs long, words long").groupBy("leaf").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).collect()
    total, words = sum(r["docs"] for r in sizes), sum(r["words"] for r in sizes)
    # leaf by leaf, numbers for as many groups as its words need
    groups = np.zeros(1 << DEPTH, np.int64)
    for r in sizes:
        groups[r["leaf"]] = -(-r["words"] // GROUP_WORDS)
    base = np.cumsum(groups) - groups

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for v in vectors(batch.column(1)):
                some = np.flatnonzero(v.n > 0)
                if not len(some):
                    continue
                leaf = tree.value.leaves(*sketched(v), len(v.n))[some]
                group = base[leaf] + (turn + np.arange(len(some))) % groups[leaf]
                turn += len(some)
                cut = np.append(v.at[some], len(v.term))
                pieces = lambda x, size: pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((cut * size).astype(np.int32)), pa.py_buffer(x)])
                yield pa.RecordBatch.from_arrays([pa.array(group), batch.column(0).take(pa.array(v.row[some])), pa.array(v.n[some]), pieces(v.term, 8), pieces(v.tf.astype("<u4"), 4)], ["group", "doc_id", "n", "terms", "tfs"])

    def order(t: pa.Table) -> Iterator[pa.RecordBatch]:
        got = t.combine_chunks()
        term, tf = (np.frombuffer(b"".join(got[c].to_pylist()), k) for c, k in (("terms", np.uint64), ("tfs", "<u4")))
        size = np.array([len(x) // 8 for x in got["terms"].to_pylist()])
        doc = np.repeat(np.arange(len(size)), size)
        worth = impacts(tf, np.repeat(got["n"].to_numpy(), size), total, words)
        return clusters(got["doc_id"].combine_chunks(), doc, term, worth, bisected(doc, term, np.arange(len(size)), CLUSTER))

    def ordered(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(order(t)))

    dealt = rows.select("doc_id", "text").mapInArrow(deal, "group long, doc_id long, n long, terms binary, tfs binary")
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    dealt.groupBy("group").applyInArrow(ordered, CLUSTER_KIND).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return Index(spark.read.schema(CLUSTER_KIND).parquet(path), total, words)


class Block:
    """Items of one block: their distinct terms, and for each item the places of its own among them."""

    def __init__(self, items: list[np.ndarray]):
        self.terms, at = np.unique(np.concatenate([np.empty(0, np.uint64), *items]), return_inverse=True)
        sizes = np.array([len(x) for x in items], np.int64)
        self.item, self.at, self.n = np.repeat(np.arange(len(items)), sizes), at, len(items)
        self.weight = np.zeros(len(self.terms), np.int64)
        self.floor = np.ones(len(items), np.int64)  # a score that the k-th has at least

    def found(self, terms: np.ndarray) -> np.ndarray:
        """Where each term of the block is in a cluster's, or -1."""
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        return np.where(terms[at] == self.terms, at, -1)

    def bounds(self, row: dict) -> np.ndarray:
        """The most that a document of the cluster can score, for each item."""
        at = self.found(np.frombuffer(row["terms"], np.uint64))
        top = np.where(at >= 0, np.frombuffer(row["tops"], "<i4")[at], 0).astype(np.int64) * self.weight
        return np.bincount(self.item, top[self.at].astype(np.float64), minlength=self.n).astype(np.int64)

    def scores(self, row: dict, items: np.ndarray) -> np.ndarray:
        """item x document: the scores of a cluster's documents for some items (ascending)."""
        mine = np.isin(self.item, items)
        own, at = self.item[mine], self.at[mine]
        where = self.found(np.frombuffer(row["terms"], np.uint64))
        own, at = own[where[at] >= 0], at[where[at] >= 0]
        used, back = np.unique(at, return_inverse=True)
        df = np.frombuffer(row["dfs"], "<i4").astype(np.int64)
        begin, size = (np.cumsum(df) - df)[where[used]], df[where[used]]
        pick = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        worth = np.zeros((len(used), len(row["doc_ids"])), np.int64)
        line = np.repeat(np.arange(len(used)), size)
        worth[line, np.frombuffer(row["places"], "u1")[pick]] = np.frombuffer(row["impacts"], "<i4")[pick] * self.weight[used][line]
        out = np.zeros((len(items), worth.shape[1]), np.int64)
        if len(own):
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out[np.searchsorted(items, own[starts])] = np.add.reduceat(worth[back], starts, axis=0)
        return out


class Best:
    """The k best of each item that a task has met."""

    def __init__(self, block: Block, k: int):
        self.k, self.floor, self.top = k, block.floor.copy(), np.zeros((block.n, k), np.int64)
        self.parts: list[tuple] = []

    def add(self, items: np.ndarray, scores: np.ndarray, ids: list) -> None:
        both = np.concatenate([self.top[items], scores], axis=1)
        self.top[items] = -np.partition(-both, self.k - 1, axis=1)[:, : self.k]
        self.floor[items] = np.maximum(self.floor[items], self.top[items].min(axis=1))
        r, c = np.nonzero(scores >= self.floor[items, None])
        if len(r):
            self.parts.append((items[r], scores[r, c], np.array([ids[x] is None for x in c]), np.array([ids[x] or 0 for x in c], np.int64)))

    def rows(self) -> pa.RecordBatch:
        item, score, null, doc = (np.concatenate(x) if x else np.empty(0, t) for x, t in zip(zip(*self.parts) if self.parts else [()] * 4, (np.int64, np.int64, bool, np.int64)))
        keep = score >= self.floor[item]
        item, score, null, doc = item[keep], score[keep], null[keep], doc[keep]
        order = np.lexsort((doc, null, -score, item))
        item, score, null, doc = item[order], score[order], null[order], doc[order]
        first = np.arange(len(item)) - np.searchsorted(item, item) < self.k
        return pa.RecordBatch.from_arrays([pa.array(item[first]), pa.array(doc[first], mask=null[first]), pa.array(score[first])], ["item", "doc_id", "score"])


def visited(index: Index, block, k: int, all_clusters: bool) -> DataFrame:
    """item, doc_id, score: the k best of each task. all_clusters: every cluster that can hold one of the k best, else only
    the best of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        best = Best(b, k)
        for batch in batches:
            rows = batch.to_pylist()
            bounds = np.array([b.bounds(r) for r in rows])
            turns = np.argsort(-bounds, axis=0, kind="stable")  # for each item its clusters, the best bound first
            for turn in range(len(rows) if all_clusters else 1):
                at = turns[turn]
                reach = bounds[at, np.arange(b.n)]
                open_ = np.flatnonzero((reach >= best.floor) & (reach > 0))
                if not len(open_):
                    break
                for c in np.unique(at[open_]):
                    items = open_[at[open_] == c]
                    best.add(items, b.scores(rows[c], items), rows[c]["doc_ids"])
        yield best.rows()

    return index.rows.mapInArrow(run, "item long, doc_id long, score long")


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, terms) of the items, block by block."""
    ids: list = []
    terms: list[np.ndarray] = []
    held = 0
    for r in items.toLocalIterator():
        own = [x for v in vectors(pa.array([r[1]], pa.string())) for x in v.term]
        ids.append(r[0])
        terms.append(np.array(own, np.uint64))
        held += len(own)
        if len(ids) >= ITEMS or held >= TERMS:
            yield ids, terms
            ids, terms, held = [], [], 0
    if ids:
        yield ids, terms


def search(index: Index, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """key, rank, doc_id, score: the k documents with the highest scores above 0 for each item."""
    spark = items.sparkSession
    kind = items.schema[key].dataType.simpleString()
    out = spark.createDataFrame([], f"{key} {kind}, rank int, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 32)  # clusters, some 300 kB each
    try:
        for ids, terms in _blocks(items.select(F.col(key), F.col(text).cast("string"))):
            block = Block(terms)
            for r in _document_counts(index, block.terms).collect():
                block.weight[r["at"]] = math.floor(1000 * math.log((2 * index.docs + 2) / (2 * r["df"] + 1)))
            seen = visited(index, spark.sparkContext.broadcast(block), k, False)
            reached = seen.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k)
            for r in reached.select("item", "score").collect():
                block.floor[r["item"]] = max(1, r["score"])
            found = visited(index, spark.sparkContext.broadcast(block), k, True).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            named = spark.createDataFrame(list(enumerate(ids)), f"item long, {key} {kind}")
            out = out.unionByName(stage(found.join(F.broadcast(named), "item").select(key, "rank", "doc_id", "score")))
    finally:
        spark.conf.set(name, before)
    return out


def _document_counts(index: Index, terms: np.ndarray) -> DataFrame:
    """at (a place in terms), df: how many documents hold each term that any holds."""
    shared = index.rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for held, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(held, np.uint64)
                at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                df += np.where(own[at] == wanted, np.frombuffer(counts, "<i4")[at], 0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["at", "df"])

    return index.rows.select("terms", "dfs").mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for every benchmark item."""
    index = build(table(spark, sf_dir, "documents"))
    out = search(index, table(spark, sf_dir, "benchmark"), 10)
    unstage(index.rows)
    return out


#: Terms in SQL: A-Z lower-cased, nothing else.
_TERMS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
with docs as (select row_number() over () as d, doc_id, {_TERMS.format("text")} as terms from documents where text is not null),
sized as (select d, doc_id, len(terms) as n, terms from docs where len(terms) > 0),
total as (select count(*)::bigint as big_n, sum(n)::bigint as l from sized),
postings as (select d, term, count(*)::bigint as tf from (select d, unnest(terms) as term from sized) group by all),
weights as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from postings, total group by term, big_n),
lengths as (select d, doc_id, 100 - 90 + ((90 * n::bigint * big_n) // l) as m from sized, total),
wanted as (select distinct row_number, item_id, term from (select row_number() over () as row_number, item_id, unnest({_TERMS.format("text")}) as term from benchmark where text is not null)),
scored as (
  select row_number, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from wanted join postings using (term) join weights using (term) join lengths using (d) group by all
)
select item_id, row_number() over (partition by row_number order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0
qualify row_number() over (partition by row_number order by score desc, doc_id) <= 10
"""
