"""Stateful operators of the streams: dedup bounded by a count of keys, and what a block has accumulated."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Recent(StatefulProcessor):
    """Lets a key through that is not among the last `size` keys let through; the oldest of them makes room for a new one.
    A key that is met again is not refreshed: only what was let through counts as added."""

    def __init__(self, size: int, columns: list[str], key: str):
        self.size, self.columns, self.key = size, columns, columns.index(key)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "key string", "slot long")
        self.ring = handle.getMapState("ring", "slot long", "key string")
        self.added = handle.getValueState("added", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.added.get()[0] if self.added.exists() else 0
        begun = n
        for batch in rows:
            passed = []
            for at, k in enumerate(batch[self.columns[self.key]]):
                if self.known.containsKey((k,)):
                    continue
                slot = n % self.size
                if self.ring.containsKey((slot,)):
                    self.known.removeKey((self.ring.getValue((slot,))[0],))
                self.ring.updateValue((slot,), (k,))
                self.known.updateValue((k,), (slot,))
                n += 1
                passed.append(at)
            if passed:
                yield batch.iloc[passed][self.columns]
        if n != begun:
            self.added.update((n,))

    def close(self) -> None:
        pass


def recent_only(df: DataFrame, key: str, size: int, shards: int = 8) -> DataFrame:
    """The rows of a stream whose key is not among the last `size` keys that came through, rows without a key not at all.

    Keys are dealt to shards by their hash, each with its part of the size, so the bound holds for each shard. The marks are
    committed with the batch: if its sink fails, the batch is replayed from the state before it, and is let through again."""
    columns = df.columns
    dealt = df.where(F.col(key).isNotNull()).withColumn("_shard", F.pmod(F.xxhash64(key), F.lit(shards)))
    processor = Recent(max(1, -(-size // shards)), columns, key)
    return dealt.groupBy("_shard").transformWithStateInPandas(statefulProcessor=processor, outputStructType=df.schema, outputMode="Update", timeMode="None")


ENTRY = "block_hash string, url string, subtree_index long, txids array<string>, stump_ref string, done boolean"
DRAINED = "block_hash string, url string, part long, entries array<struct<subtree_index: long, txids: array<string>, stump_ref: string>>"


class Accumulator(StatefulProcessor):
    """For each block its entries (url, subtree, txids, stump reference) until it is done; then each url's entries in rows of
    at most `size`, once. Entries have a time to live; those that come after the drain wait for another."""

    def __init__(self, size: int, ttl_ms: int | None):
        self.size, self.ttl_ms = size, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # by url and number, so that a url's entries come together and no value grows
        self.entries = handle.getMapState("entries", "url string, n long", "subtree_index long, txids array<string>, stump_ref string", self.ttl_ms)
        self.count = handle.getValueState("count", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, done = self.count.get()[0] if self.count.exists() else 0, False
        for batch in rows:
            for r in batch.itertuples():
                if r.done is True or r.done == True:  # noqa: E712  a numpy bool is not the Python one
                    done = True
                else:
                    self.entries.updateValue((r.url, n), (int(r.subtree_index), list(r.txids), r.stump_ref))
                    n += 1
        if not done:
            self.count.update((n,))
            return
        held: dict[str, list] = {}
        part: dict[str, int] = {}
        for (url, _), entry in self.entries.iterator():
            held.setdefault(url, []).append(entry)
            if len(held[url]) == self.size:
                yield self._row(key[0], url, part, held.pop(url))
        for url, own in held.items():
            yield self._row(key[0], url, part, own)
        self.entries.clear()
        self.count.clear()

    @staticmethod
    def _row(block: str, url: str, part: dict[str, int], entries: list) -> pd.DataFrame:
        k = part[url] = part.get(url, -1) + 1
        ordered = sorted(entries, key=lambda e: e[0])
        return pd.DataFrame({"block_hash": [block], "url": [url], "part": [k], "entries": [[{"subtree_index": i, "txids": list(t), "stump_ref": s} for i, t, s in ordered]]})

    def close(self) -> None:
        pass


def accumulated(entries: DataFrame, size: int = 100, ttl_seconds: int = 600) -> DataFrame:
    """DRAINED rows of a stream of ENTRY rows: what a block's url has gathered, when a row with `done` comes for the block."""
    return entries.groupBy("block_hash").transformWithStateInPandas(statefulProcessor=Accumulator(size, ttl_seconds * 1000), outputStructType=DRAINED, outputMode="Update", timeMode="ProcessingTime")
