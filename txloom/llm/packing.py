"""Packing of token sequences: shortest-pack-first over the length histogram.

1. Each document's ids are staged with its length modulo the sequence length and its rank among the documents of
   that remainder in the same task. Whole multiples of the sequence length fill sequences of their own.
2. The histogram of remainders (at most `size` rows) goes to the driver. Lengths are placed longest first, each
   into the shortest of the packs that the total needs; packs of one pattern are one entry with a count, so the work
   depends on the histogram's width and not on the number of documents. A length that does not fit even the shortest
   pack is cut: the pack is filled, and the rest goes back to the histogram at its own (smaller) length. So all
   sequences but the last few tokens' worth are full: total padding is below one sequence.
3. Patterns name ranges of ranks for each remainder; documents find theirs by remainder and rank (rank in the task
   plus the counts of the tasks before).

Nothing of a document's size reaches the driver: only the histogram. The join of step 3 has the task in its key,
so a length that a third of all documents share is spread.

Edge cases: a null text is an empty one and has only its end id; repeated rows are packed one by one; an empty
table gives no pieces; further input columns are dropped.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txloom.llm.bpe import byte_chars, read_spec
from txloom.llm.common import small_batches, stage, table, trim

ROWS = 1024
#: Tokens by which a pack may overtake the shortest one when many short pieces are dealt out at once.
QUANTUM = 32


def byte_encoder(spec: str):
    """tiktoken's encoder for a byte-level tokenizer file: same vocabulary, same merges."""
    import public_tokenizers
    import tiktoken

    d = json.loads(spec)
    byte = {c: b for b, c in enumerate(byte_chars())}
    ranks = {bytes(byte[c] for c in t): i for t, i in d["model"]["vocab"].items()}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in d["added_tokens"]})


def encoded(spec: str, end: int = 1) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step from batches of keys and texts to batches of keys and ids, with the end id appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_encoder(spec)  # a task's own: a worker keeps nothing for later stages
        encode, last = own.encode_to_numpy, np.array([end], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [np.concatenate([encode(t or "", allowed_special="all").astype("<u4"), last]).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["key", "ids"])
        del own, encode
        trim()

    return run


def tokenise(docs: DataFrame, spec: str, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (BINARY, little-endian unsigned 32 bits) with the end id appended."""
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(encoded(spec, end), f"key {kind}, ids binary")
    return out.select(F.col("key").alias(key), "ids")


def place(histogram: dict[int, int], size: int) -> tuple[list[tuple], int]:
    """Placements for count documents of each length below size, and the number of sequences.

    A placement (of, rank, n, copies, start, length, sequence, offset) says: the n documents of length `of` from rank
    on put their ids [start, start + length) into sequences from `sequence` on, `copies` to each, from offset on.
    """
    total = sum(length * n for length, n in histogram.items())
    packs = -(-total // size)
    at_fill: dict[int, list[tuple[int, int]]] = defaultdict(list)  # fill: runs of sequences of one pattern
    fills = [0] if packs else []
    if packs:
        at_fill[0].append((0, packs))
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for length, n in histogram.items():
        if n and length:
            runs[length].append((length, 0, n, 0))
    out: list[tuple] = []

    def put(fill: int, first: int, n: int) -> None:
        if n and fill < size:
            if not at_fill[fill]:
                heapq.heappush(fills, fill)
            at_fill[fill].append((first, n))

    for length in range(size - 1, 0, -1):
        for of, rank, n, start in runs.pop(length, ()):
            while n:
                fill = fills[0]
                first, count = at_fill[fill].pop()
                if not at_fill[fill]:
                    heapq.heappop(fills)
                space = size - fill
                if space >= length:
                    copies = max(1, min(space // length, QUANTUM // length, n // count))
                    used = min(count, n // copies)
                    out.append((of, rank, used * copies, copies, start, length, first, fill))
                    put(fill + copies * length, first, used)
                    took = used * copies
                else:
                    took = used = min(count, n)
                    out.append((of, rank, used, 1, start, space, first, fill))
                    runs[length - space].append((of, rank, used, start + space))
                put(fill, first + used, count - used)
                rank += took
                n -= took
    return out, packs


def pack(tokens: DataFrame, size: int = 2048, key: str = "doc_id", ids: str = "ids", step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> DataFrame:
    """Pieces (key, start, length, ids, doc_tokens, sequence_id, offset) of all rows of tokens (key, ids).

    Each id lies in exactly one piece; the pieces of a sequence leave no gap and no sequence exceeds size.
    step: what makes the ids from the column `ids`, in the Python worker that ranks them: two steps would hold two workers a task.
    """
    kind = tokens.schema[key].dataType.simpleString()

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, full = TaskContext.get().partitionId(), np.zeros(size, np.int64), 0
        for batch in step(batches):
            ids = batch.column(1).to_pylist()
            n = np.array([len(b or b"") // 4 for b in ids], np.int64)
            rest, ranks = n % size, np.empty(len(n), np.int64)
            for i, r in enumerate(rest.tolist()):
                ranks[i] = seen[r]
                seen[r] += 1
            whole = n // size
            before = full + np.cumsum(whole) - whole
            full += int(whole.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(rest.astype(np.int32)), pa.array(ranks), pa.array(before), pa.array(_narrow(ids), pa.binary())], ["key", "part", "rest", "rank", "full", "ids"])
        trim()

    rows = stage(tokens.select(F.col(key).alias("key"), ids).mapInArrow(ranked, f"key {kind}, part int, rest int, rank long, full long, ids binary"))
    counts = rows.groupBy("part", "rest").agg(F.count("*").alias("n"))
    histogram = dict(counts.groupBy("rest").agg(F.sum("n")).collect())
    placed, packs = place(histogram, size)
    cols = np.array(placed, np.int64).reshape(-1, 8)
    cols = cols[np.lexsort((cols[:, 4], cols[:, 0]))]
    bounds = np.searchsorted(cols[:, 0], np.arange(size + 1))
    before = counts.select("part", "rest", F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                names, parts, rests, ranks, fulls, blobs = (batch.column(i).to_pylist() for i in range(6))
                out: list[tuple] = []
                for k, part, rest, rank, full, blob in zip(names, parts, rests, ranks, fulls, blobs):
                    ids = _wide(blob)
                    n = len(ids)
                    for i in range(n // size):
                        out.append((k, i * size, size, ids[i * size : (i + 1) * size].tobytes(), n, (part + 1 << 40) + full + i, 0))
                    own = cols[bounds[rest] : bounds[rest + 1]] if rest else cols[:0]
                    for _, first, _, copies, start, length, seq, offset in own[(own[:, 1] <= rank) & (rank < own[:, 1] + own[:, 2])].tolist():
                        up, turn = divmod(rank - first, copies)
                        start += n - rest
                        out.append((k, start, length, ids[start : start + length].tobytes(), n, seq + up, offset + turn * length))
                kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        trim()

    found = rows.join(before, ["part", "rest"]).select("key", "part", "rest", (F.col("rank") + F.col("base")).alias("rank"), "full", "ids")
    out = found.mapInArrow(pieces, f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("key", key)


def _narrow(ids: list[bytes | None]) -> list[bytes]:
    """A leading byte 2 or 4, then ids of that many bytes each: staged ids take half the space where they can."""
    out = []
    for b in ids:
        x = np.frombuffer(b or b"", "<u4")
        out.append(b"\4" + (b or b"") if len(x) and x.max() > 65535 else b"\2" + x.astype("<u2").tobytes())
    return out


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype("<u4")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    made = pack(texts, ids="text", step=encoded(read_spec(public_tokenizers.path("byte_bpe_50k.json"))))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents."""
    small_batches(spark)
    return packed_documents(docs)
