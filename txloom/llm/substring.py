"""Substring deduplication by difference-cover anchors.

Two equal windows of `window` words may begin anywhere. The positions whose remainder modulo `period` lies in a
difference cover are anchors: for any two positions i, j there is a shift below the period that takes both to anchors.
So equal windows share an equal anchor of window - period + 1 words, and only anchors are hashed and matched at first.

1. Blocks of documents send the distinct hashes of their anchors to ranges of the hash space (twice those that a
   block holds more than once); a range sends each block back the hashes that occur again. A passage that a third of
   all documents share is sent at most twice by each block.
2. Anchors that occur again extend to the windows that hold them; those windows are matched the same way, on 96 bits,
   whole and unchanged. No pairs are formed, so a group of copies costs its length.
3. Blocks mark the words that such windows cover, and join what is left.

Text moves once (blocks are one reused exchange); rows of hashes are packed arrays. Nothing goes to the driver but
the total size of the text. Equal hashes stand for equal words (64 bits) and windows (96 bits).

Edge cases: null and empty texts have no words and keep "" ; a text shorter than a window keeps all its words;
repeated rows are copies of each other, so both lose what they share; null keys are kept; other columns are passed
through by `dedup_rows`, but for those named like its results (kept, n_words, n_removed, spans), which it replaces, and
its helper column `_txl_block`; `cut_repeats` hands those on as well.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.llm.common import small_batches, table, trim
from txloom.llm.wordhash import SECOND, slices, split_by_hash, windows

WINDOW = 35
PERIOD = 13
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20


def difference_cover(period: int) -> list[int]:
    """A small set of remainders whose differences give every remainder, found greedily by the most new differences."""
    cover, have = [0], {0}
    while len(have) < period:
        new = lambda c: {(c - d) % period for d in cover} | {(d - c) % period for d in cover}
        best = max((c for c in range(period) if c not in cover), key=lambda c: (len(new(c) - have), -c))
        have |= new(best)
        cover.append(best)
    return sorted(cover)


def _send(h: np.ndarray, low: np.ndarray | None, block: int, ranges: int) -> pa.Table:
    """Distinct hashes (those that occur again, twice), a row for each range of the hash space that gets any."""
    order = np.lexsort((low, h)) if low is not None else np.argsort(h, kind="stable")
    h, low = h[order], low[order] if low is not None else None
    same = h[1:] == h[:-1]
    if low is not None:
        same &= low[1:] == low[:-1]
    keep = np.ones(len(h), bool)
    keep[2:] = ~(same[1:] & same[:-1])
    h, low = h[keep], low[keep] if low is not None else None
    at = split_by_hash(h, ranges)
    full = np.flatnonzero(np.diff(at))
    cut = lambda x: [x[at[k] : at[k + 1]].tobytes() for k in full.tolist()]
    return pa.table({"span": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), block), pa.int32()), "h": pa.array(cut(h), pa.binary()), "low": pa.array(cut(low) if low is not None else [b""] * len(full), pa.binary())})


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    parts = [np.frombuffer(b, kind) for b in column.to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _again(sent: pa.Table) -> pa.Table:
    """For each block, which of the hashes that it sent to this range occur more than once."""
    sizes = [len(b) // 8 for b in sent["h"].to_pylist()]
    h, block = _joined(sent["h"], "<u8"), np.repeat(sent["block"].to_numpy(), sizes)
    low = _joined(sent["low"], "<u4")
    order = np.lexsort((low, h)) if len(low) else np.argsort(h, kind="stable")
    h, block, low = h[order], block[order], low[order] if len(low) else None
    same = h[1:] == h[:-1]
    if low is not None:
        same &= low[1:] == low[:-1]
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    h, block, low = h[twice], block[twice], low[twice] if low is not None else None
    order = np.argsort(block, kind="stable")
    h, block, low = h[order], block[order], low[order] if low is not None else None
    own, at = np.unique(block, return_index=True)
    at = np.append(at, len(block))
    cut = lambda x: [x[at[k] : at[k + 1]].tobytes() for k in range(len(own))]
    return pa.table({"block": pa.array(own, pa.int32()), "h": pa.array(cut(h), pa.binary()), "low": pa.array(cut(low) if low is not None else [b""] * len(own), pa.binary())})


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _whole(own: np.ndarray, n: int, size: int) -> np.ndarray:
    """Whether the `size` words from each of n positions on lie in one text."""
    rows = np.repeat(np.arange(len(own) - 1), np.diff(own))
    return np.arange(n) + size <= own[1:][rows[:n]]


def _anchors(h: np.ndarray, own: np.ndarray, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of some texts."""
    size = window - period + 1
    a = windows(h, size)
    place = np.arange(len(h)) - np.repeat(own[:-1], np.diff(own))
    cover = np.zeros(period, bool)
    cover[difference_cover(period)] = True
    at = np.flatnonzero(_whole(own, len(a), size) & cover[place[: len(a)] % period])
    return at, a[at]


def dedup_rows(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, text: str = "text") -> DataFrame:
    """docs with `kept` (kept words joined by one space), `n_words`, `n_removed` and `spans` (start, length in words, of
    what went), added or put in the place of columns of those names."""
    if window < period:
        raise ValueError("the window must be at least as long as the period")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // 2)
    names = docs.columns
    salted = docs.withColumn("_txl_block", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(blocks).cast("long")).cast("int"))
    salted = salted.repartition(parts, "_txl_block")
    sent, back = "span int, block int, h binary, low binary", "block int, h binary, low binary"

    def send_anchors(group: pa.Table) -> pa.Table:
        found = [_anchors(h, own, window, period)[1] for _, h, own in slices(group[text])]
        return _send(np.concatenate(found), None, group["_txl_block"][0].as_py(), blocks)

    def send_windows(group: pa.Table, dups: pa.Table) -> pa.Table:
        if not group.num_rows or not dups.num_rows:
            return pa.table({"span": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "h": pa.array([], pa.binary()), "low": pa.array([], pa.binary())})
        known, hs, lows = np.sort(_joined(dups["h"], "<u8")), [], []
        for _, h, own in slices(group[text]):
            at, a = _anchors(h, own, window, period)
            hits = at[_among(a, known)]
            near = np.zeros(len(h) + 1, np.int64)  # windows that begin up to period - 1 words before such an anchor
            np.add.at(near, np.maximum(hits - period + 1, 0), 1)
            np.add.at(near, hits + 1, -1)
            first = windows(h, window)
            at = np.flatnonzero((np.cumsum(near[:-1])[: len(first)] > 0) & _whole(own, len(first), window))
            hs.append(first[at])
            lows.append((windows(h, window, SECOND)[at] >> np.uint64(32)).astype(np.uint32))
        return _send(np.concatenate(hs), np.concatenate(lows), group["_txl_block"][0].as_py(), blocks)

    def cut_out(group: pa.Table, dups: pa.Table) -> pa.Table:
        h_known, low_known = _joined(dups["h"], "<u8"), _joined(dups["low"], "<u4")
        order = np.argsort(h_known, kind="stable")
        known = h_known[order]
        exact = set(zip(known.tolist(), low_known[order].tolist())) if len(np.unique(known)) < len(known) else None
        texts = group[text]
        kept: list = []
        counts: list = []
        removed: list = []
        spans: list = []
        raw = texts.to_pylist()
        for row, h, own in slices(texts):
            gone = np.zeros(len(h) + 1, np.int64)
            first = windows(h, window)
            at = np.flatnonzero(_among(first, known) & _whole(own, len(first), window))
            if len(at):
                low = (windows(h, window, SECOND)[at] >> np.uint64(32)).astype(np.uint32)
                if exact is None:
                    at = at[low_known[order][np.searchsorted(known, first[at])] == low]
                else:
                    at = at[[p in exact for p in zip(first[at].tolist(), low.tolist())]]
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
            gone = np.cumsum(gone[:-1]) > 0
            for i in range(len(own) - 1):
                own_gone = gone[own[i] : own[i + 1]]
                words = (raw[row + i] or "").encode().split()
                n = int(own_gone.sum())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own_gone.view(np.int8), [0]]))) if n else ()
                spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
                kept.append(b" ".join(compress(words, (~own_gone).tolist()) if n else words).decode())
                counts.append(len(own_gone))
                removed.append(n)
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        made = {"kept": pa.array(kept, pa.string()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, kinds)}
        raw.clear()
        trim()
        return pa.table({c: group[c] for c in names if c not in made} | made)

    again = lambda rows: rows.repartition(parts, "span").groupBy("span").applyInArrow(_again, back).repartition(parts, "block")
    by_block = salted.groupBy("_txl_block")
    anchors = again(by_block.applyInArrow(send_anchors, sent))
    longer = again(by_block.cogroup(anchors.groupBy("block")).applyInArrow(send_windows, sent))
    made = ["kept", "n_words", "n_removed", "spans"]
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in made)
    return by_block.cogroup(longer.groupBy("block")).applyInArrow(cut_out, f"{rest}, kept string, n_words long, n_removed long, spans array<struct<start:long,length:long>>")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 35-word windows that occur again anywhere."""
    found = dedup_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = """
with w as (
  select row_number() over () as r, doc_id,
    list_filter(string_split_regex(coalesce("text", ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
p as (select r, doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35),
h as (select r, i, md5(array_to_string(ws[i:i + 34], ' ')) as k from p),
d as (select k from h group by k having count(*) > 1),
m as (select distinct r, unnest(range(i, i + 35)) as j from h join d using (k)),
g as (select r, list(j) as js from m group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(len(js), 0)::bigint as n_removed,
  sha256(array_to_string(case when js is null then ws else
    list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: not list_contains(js, z[2])), lambda z: z[1]) end, ' ')) as kept_sha256
from w left join g using (r)
"""


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without repeated windows; texts that hold none stay as they are."""
    small_batches(spark)
    names = docs.columns
    # columns named like those that dedup_rows makes go by other names meanwhile
    kept_as = {n: f"_in_{n}" for n in names if n in ("kept", "n_words", "n_removed", "spans")}
    found = dedup_rows(docs.withColumnsRenamed(kept_as))
    new = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).withColumn("text", new)
    return found.select(*[F.col(kept_as.get(n, n)).alias(n) for n in names])
