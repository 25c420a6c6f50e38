"""Stupid-backoff language-model scores, computed relationally.

Each block of documents counts its distinct n-grams of every order (words as they are) and sends them to ranges of the
hash space: the count tables, partitioned by hash. A range adds the counts of all blocks, and each n-gram of a block is
joined to what the other blocks hold of it; blocks then sum the scores of their documents. Blocks pre-aggregate, so a
phrase that a third of all documents hold is sent once by each block. A block is what one task packed (never a hash of
the content, so equal rows spread); its texts travel once, compressed. An n-gram travels as its part of a sorted list
of 64-bit hashes, coded by differences; the answer is one small number in the place of each.

The score of a word after its context of order - 1 words is c(n-gram) / c(context) for the longest n-gram that stands
anywhere, times `backoff` for each order given up; at order 1 it is c(word) / N. A count of 0 alone backs off. All counts
cover all documents, and N their words. With `leave_out` (the default) the counts and N leave the scored row itself out,
as a text says nothing about itself: else each of its n-grams would be known and nothing would ever back off. A word
that stands nowhere else is given the count 1.

Edge cases: null and empty texts have 0 words and score 0; repeated rows count as often as they stand (each knows the
others); null ids are kept; an empty table gives no rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.llm.common import table, trim
from txloom.llm.wordhash import mixed, ordered, slices, split_by_hash, windows, word_count

BACKOFF, ORDER = 0.4, 3
#: Bytes of text in a block (a longer single text is a block).
BLOCK_BYTES = 8 << 20
#: Low bytes of a hash that are sent as they are.
LOW = 5


def packed(docs: DataFrame, block_bytes: int) -> DataFrame:
    """block (an id of its task and place), data (the rows as a compressed Arrow stream) of docs (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held, size = TaskContext.get().partitionId() << 24, 0, [], 0

        def block() -> pa.RecordBatch:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block", "data"])

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False) + 16)
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                to = max(at + (not held), int(np.searchsorted(ends, before + block_bytes - size, "right")))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    size += int(ends[to - 1] - before)
                if to < batch.num_rows:
                    yield block()
                    made, held, size = made + 1, [], 0
                at = to
        if held:
            yield block()

    return docs.mapInArrow(run, "block long, data binary")


def _grams(data: bytes, order: int) -> tuple[pa.Table, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The rows of a block, how many words each has, the row of each word, and for each order the n-gram hashes; that of
    the n-gram that ends at word i is in place i - n + 1, and n-grams that cross rows are there too."""
    rows = pa.ipc.open_stream(data).read_all()
    words, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for _, h, own in slices(rows["text"]):
        words.append(h)
        sizes.append(np.diff(own))
    h, n = np.concatenate(words), np.concatenate(sizes)
    return rows, n, np.repeat(np.arange(len(n), dtype=np.int32), n), [mixed(h + np.uint64(1)), *[windows(h, k) for k in range(2, order + 1)]]


def _inside(rows: np.ndarray, k: int) -> np.ndarray:
    """Which of the k-grams lie in one row."""
    return rows[k - 1 :] == rows[: len(rows) - k + 1] if len(rows) >= k else np.zeros(0, bool)


def _planes(x: np.ndarray, kind: str) -> bytes:
    """Numbers as compressed byte planes: small numbers leave all planes but one empty."""
    width = np.dtype(kind).itemsize
    return pa.compress(np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, width).T).tobytes(), "zstd", asbytes=True) if len(x) else b""


def _unplanes(data: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, n * width, "zstd") if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(-1)


def _pack_sorted(h: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted hashes: their low bytes, and the differences of the rest."""
    low = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW]).tobytes()
    return low, _planes(np.diff(h >> np.uint64(8 * LOW), prepend=np.uint64(0)), "<u4")


def _unpack_sorted(low: bytes, high: bytes) -> np.ndarray:
    n = len(low) // LOW
    out = np.zeros((n, 8), np.uint8)
    out[:, :LOW] = np.frombuffer(low, np.uint8).reshape(n, LOW)
    return out.reshape(-1).view("<u8") + (np.cumsum(_unplanes(high, n, "<u4").astype(np.uint64)) << np.uint64(8 * LOW))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", backoff: float = BACKOFF, order: int = ORDER, leave_out: bool = True, block_bytes: int = 0) -> DataFrame:
    """key, n_words, log_score (sum over the words of the natural logarithm of their scores) for each row."""
    spark, block_bytes = docs.sparkSession, block_bytes or BLOCK_BYTES
    base = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = base.schema["key"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pc.sum(pc.binary_length(batch.column(0))).as_py() or 0], pa.int64()), pa.array([word_count(batch.column(0))], pa.int64())], ["size", "words"])

    size, words = base.select("text").mapInArrow(measure, "size long, words long").agg(F.sum("size"), F.sum("words")).head()
    spans = max(1, -(-(size or 0) // block_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spans)
    words = words or 0

    def send(group: pa.Table) -> pa.Table:
        _, _, rows, grams = _grams(group["data"][0].as_py(), order)
        cols: list[list] = [[] for _ in range(5)]
        for k in range(1, order + 1):
            h, n = np.unique(grams[k - 1][_inside(rows, k)], return_counts=True)
            grams[k - 1] = None
            at = split_by_hash(h, spans)
            for s in np.flatnonzero(np.diff(at)).tolist():
                part = slice(at[s], at[s + 1])
                for c, x in zip(cols, (s, k, *_pack_sorted(h[part]), _planes(n[part], "<u4"))):
                    c.append(x)
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        del grams, rows, h, n
        trim()
        block = pa.array(np.full(len(cols[0]), group["block"][0].as_py()), pa.int64())
        return pa.table([block, *[pa.array(c, t) for c, t in zip(cols, kinds)]], ["block", "span", "k", "low", "high", "n"])

    def add(group: pa.Table) -> pa.Table:
        answers = []
        for k in range(1, order + 1):
            own = group.filter(pc.equal(group["k"], k))
            low = own["low"].to_pylist()
            if not low:
                continue
            sizes = [len(x) // LOW for x in low]
            h = np.concatenate([_unpack_sorted(a, b) for a, b in zip(low, own["high"].to_pylist())])
            n = np.concatenate([_unplanes(b, m, "<u4") for b, m in zip(own["n"].to_pylist(), sizes)]).astype(np.int64)
            at = ordered(h)
            h, n = h[at], n[at]
            begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            others = np.empty(len(h), np.int64)
            others[at] = np.repeat(np.add.reduceat(n, begins), np.diff(np.append(begins, len(h)))) - n
            ends = np.cumsum(sizes)
            made = [_planes(others[e - m : e], "<u8") for e, m in zip(ends.tolist(), sizes)]
            answers.append(pa.table([own["block"], own["span"], own["k"], pa.array(sizes, pa.int32()), pa.array(made, pa.binary())], ["block", "span", "k", "size", "n"]))
        del h, n, at, others
        trim()
        return pa.concat_tables(answers)

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({"key": pa.array([], pa.null()), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())})
        rows, sizes, row_of, grams = _grams(group["data"][0].as_py(), order)
        total = len(row_of)
        place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        logs, open_ = np.zeros(total), np.ones(total, bool)
        others: list[np.ndarray] = []
        for k in range(1, order + 1):
            inside = np.flatnonzero(_inside(row_of, k))
            h, of = grams[k - 1][inside], row_of[inside]
            grams[k - 1] = None
            count = np.zeros(total)  # by the word that the n-gram ends with
            if len(h):
                at = ordered(h)
                h, of = h[at], of[at]
                new = np.concatenate([[True], h[1:] != h[:-1]])
                begins = np.flatnonzero(new)
                runs = np.diff(np.append(begins, len(h)))
                mine = answers.filter(pc.equal(answers["k"], k)).sort_by("span")
                c = np.concatenate([_unplanes(b, m, "<u8") for b, m in zip(mine["n"].to_pylist(), mine["size"].to_pylist())]).astype(np.int64)
                c = np.repeat(c + runs, runs)
                if leave_out:
                    begins = np.flatnonzero(new | np.concatenate([[True], of[1:] != of[:-1]]))
                    runs = np.diff(np.append(begins, len(h)))
                    c -= np.repeat(runs, runs)
                count[inside[at] + k - 1] = c
            others.append(count)
        left = np.maximum(1, words - np.repeat(sizes, sizes) if leave_out else np.full(total, words))
        longest = np.minimum(place + 1, order)
        for k in range(order, 1, -1):
            hit = np.flatnonzero(open_ & (longest >= k) & (others[k - 1] > 0))
            logs[hit] = np.log(others[k - 1][hit] / others[k - 2][hit - 1]) + (longest[hit] - k) * np.log(backoff)
            open_[hit] = False
        hit = np.flatnonzero(open_)
        logs[hit] = np.log(np.maximum(1, others[0][hit]) / left[hit]) + (longest[hit] - 1) * np.log(backoff)
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        ends = np.cumsum(sizes)
        del others, grams, logs, left, longest, place, row_of, open_
        trim()
        return pa.table([rows["key"], pa.array(sizes, pa.int64()), pa.array(sums[ends] - sums[ends - sizes], pa.float64())], ["key", "n_words", "log_score"])

    by_block = packed(base, block_bytes).repartition(parts, "block").groupBy("block")
    sent = by_block.applyInArrow(send, "block long, span int, k int, low binary, high binary, n binary")
    answers = sent.repartition(parts, "span").groupBy("span").applyInArrow(add, "block long, span int, k int, size int, n binary").repartition(parts, "block")
    out = by_block.cogroup(answers.groupBy("block")).applyInArrow(finish, f"key {kind}, n_words long, log_score double")
    return out.withColumnRenamed("key", key)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all documents under the counts of all others."""
    made = score(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0)
    return made.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(mean, 4).alias("mean_log_score"))


OP4_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
grams AS (SELECT r, i, w, lag(w) OVER p AS v, lag(w, 2) OVER p AS u FROM words WINDOW p AS (PARTITION BY r ORDER BY i)),
counts AS (SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY r, w) AS c1,
    CASE WHEN v IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY r, v, w) END AS c2,
    CASE WHEN u IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY r, u, v, w) END AS c3,
    count(*) OVER () - count(*) OVER (PARTITION BY r) AS others FROM grams),
before AS (SELECT *, lag(c1) OVER q AS b1, lag(c2) OVER q AS b2 FROM counts WINDOW q AS (PARTITION BY r ORDER BY i)),
logs AS (SELECT r, CASE WHEN c3 > 0 THEN ln(c3 / b2) WHEN c2 > 0 THEN ln(c2 / b1) + CASE WHEN i > 2 THEN ln({BACKOFF}) ELSE 0 END
    ELSE ln(greatest(1, c1) / greatest(1, others)) + least(i - 1, 2) * ln({BACKOFF}) END AS x FROM before),
sums AS (SELECT r, count(*) AS n, sum(x) AS s FROM logs GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, round(coalesce(s, 0.0), 4) AS log_score, round(coalesce(s / n, 0.0), 4) AS mean_log_score
FROM docs LEFT JOIN sums USING (r)
"""
