"""The handlers as streams: subtree announcements, block announcements, subtree work, and the countdown of a block.

Each handler reads a topic (a stream) and writes topics: folders of parquet, one a micro-batch, replaced if the batch is
replayed. What must be remembered lies in the state store and is committed with the batch, so a message is marked as handled
only when its batch has succeeded:

* `Retrying`: messages by key that need an object from a hub. A failed fetch is tried again when its timer fires, with
  doubling waits, and after the last attempt the message is a dead letter; a message that was handled is not handled again.
* `Countdown`: for each block the subtrees that are still to come; the counter has a time to live.

A dead letter of work counts down like a success. A counter that expired, or never was, counts as none remaining, so the block
is announced as processed (again); receivers' dedup absorbs repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from txloom.operators import merkle, seen
from txloom.sources import blobs, hub, options, readers
from txloom.sources.regtable import RegistrationTable

OUTCOME = "key string, message string, state string, attempt int, error string, data binary, fetched boolean"
TIMES = "ProcessingTime"


def whole_hashes(data: bytes) -> str | None:
    """What is wrong with a subtree's data, if anything."""
    return None if len(data) % 32 == 0 else f"{len(data)} bytes are no whole number of hashes"


def any_data(data: bytes) -> str | None:
    return None


class Retrying(StatefulProcessor):
    """For each key: the message that waits for its next attempt, or the mark that it was handled.

    Input: key, url (of the object), message, attempt (those that failed before), data (the object, if it is at hand).
    Output (OUTCOME): a row for each message that was handled (`done`) or given up (`dlq`)."""

    def __init__(self, max_attempts: int, check: Callable[[bytes], str | None] = any_data, first_wait_ms: int = 500, longest_wait_ms: int = 10_000, ttl_ms: int | None = None, **fetch):
        self.max_attempts, self.check, self.waits, self.ttl_ms = max_attempts, check, (first_wait_ms, longest_wait_ms), ttl_ms
        self.fetch = {"attempts": 1} | fetch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "url string, message string, attempt int, done boolean", self.ttl_ms)

    def _try(self, key: str, url: str, message: str, attempt: int, data: bytes | None, now: int) -> pd.DataFrame | None:
        had, error = data is not None, None
        if not had:
            data, error = hub.attempted(url, **self.fetch)
        if data is not None and (wrong := self.check(data)):
            data, error = None, wrong
        if data is not None:
            self.held.update((url, "", attempt, True))
            return self._row(key, message, "done", attempt, None, data, not had)
        attempt += 1
        if attempt >= self.max_attempts:
            self.held.clear()  # announced again it is tried again
            return self._row(key, message, "dlq", attempt, error, None, False)
        self.held.update((url, message, attempt, False))
        first, longest = self.waits
        self.handle.registerTimer(now + min(longest, first * 2 ** (attempt - 1)))
        return None

    @staticmethod
    def _row(*values) -> pd.DataFrame:
        return pd.DataFrame([values], columns=[c.split(" ")[0] for c in OUTCOME.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for batch in rows:
            for r in batch.itertuples():
                if self.held.exists():
                    break  # handled, or waiting for its timer
                data = bytes(r.data) if isinstance(r.data, (bytes, bytearray)) else None
                out = self._try(key[0], r.url, r.message, int(r.attempt or 0), data, now)
                if out is not None:
                    yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            url, message, attempt, done = self.held.get()
            if not done:
                out = self._try(key[0], url, message, attempt, None, timerValues.getCurrentProcessingTimeInMs())
                if out is not None:
                    yield out

    def close(self) -> None:
        pass


def retried(wanted: DataFrame, max_attempts: int, check: Callable[[bytes], str | None] = any_data, **more) -> DataFrame:
    """OUTCOME rows of a stream of wanted objects (key, url, message, attempt, data)."""
    held = wanted.select("key", "url", "message", F.coalesce("attempt", F.lit(0)).alias("attempt"), "data")
    return held.groupBy("key").transformWithStateInPandas(statefulProcessor=Retrying(max_attempts, check, **more), outputStructType=OUTCOME, outputMode="Update", timeMode=TIMES)


class Countdown(StatefulProcessor):
    """For each block: how many subtrees were expected and which are finished. Input: block_hash, expected (a counter to
    set) or subtree_index (of finished work). Output: block_hash, known (whether there was a counter)."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "expected long, remaining long", self.ttl_ms)
        self.done = handle.getMapState("done", "subtree_index long", "at boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        both = pd.concat(list(rows))
        for n in both["expected"].dropna().astype("int64"):
            if not (self.count.exists() and self.count.get()[0] == n):  # an announcement that repeats changes nothing
                self.count.update((int(n), int(n)))
        emit = False
        for i in sorted(set(both["subtree_index"].dropna().astype("int64"))):
            if not self.count.exists():
                emit = True
            elif not self.done.containsKey((int(i),)):
                self.done.updateValue((int(i),), (True,))
                expected, remaining = self.count.get()
                self.count.update((expected, remaining - 1))
                emit |= remaining - 1 == 0
        if emit:
            yield pd.DataFrame([(key[0], self.count.exists())], columns=["block_hash", "known"])

    def close(self) -> None:
        pass


def counted_down(counts: DataFrame, ttl_seconds: int = 600) -> DataFrame:
    """block_hash, known: a row when a block's last subtree is finished, from a stream of counts (block_hash, expected,
    subtree_index). State goes ttl_seconds after it was last written; nothing that is past is read again."""
    rows = counts.select("block_hash", F.col("expected").cast("long").alias("expected"), F.col("subtree_index").cast("long").alias("subtree_index"))
    return rows.groupBy("block_hash").transformWithStateInPandas(statefulProcessor=Countdown(ttl_seconds * 1000), outputStructType="block_hash string, known boolean", outputMode="Update", timeMode=TIMES)


COUNTS = "block_hash string, expected long, subtree_index long"
WANTED = "key string, url string, message string, attempt int, data binary"


class Topics:
    """Folders of one service: a table a topic, a folder a writer and batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, df: DataFrame, topic: str, writer: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{topic}/from={writer}/batch={batch}")

    def send(self, df: DataFrame, writer: str, batch: int) -> None:
        """Callback messages: every field of CALLBACK_MESSAGE, null where a kind has none."""
        self.put(readers.whole_callbacks(df), "callback", writer, batch)

    def stream(self, topic: str, schema: str) -> DataFrame:
        """The topic as a stream, oldest first."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{topic}")
        fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(fs_path)
        return self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{topic}")

    def read(self, topic: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{topic}")


def _started(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return df.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def _setting(opts: Mapping[str, object] | None) -> dict[str, object]:
    return dict(options.DEFAULTS) | dict(opts or {})


def _cached(batch: DataFrame, step: Callable[[DataFrame], None]) -> None:
    """Run step over a batch that is computed once: the state is read and timers fire one time only."""
    batch.persist()
    try:
        step(batch)
    finally:
        batch.unpersist()


def subtree_handler(messages: DataFrame, table: RegistrationTable, topics: Topics, checkpoint: str, opts: Mapping[str, object] | None = None, trigger: dict | None = None, **fetch) -> StreamingQuery:
    """Subtree announcements (value: JSON) to callbacks: decode, skip what was handled, fetch, store (storage mode
    `realtime`), look up, and write for each subtree

    * `callback`: SEEN_ON_NETWORK messages, a url's txids in chunks; * `seen`: registered txids with the subtree, from which
    `seen_multiple` counts; * `blobs` (a blob store); * `subtree_dlq`: messages that were given up."""
    o = _setting(opts)
    decoded = readers.decoded(messages, readers.SUBTREE_MESSAGE, "hash")
    wanted = decoded.select(
        F.col("hash").alias("key"), F.concat(F.regexp_replace("dataHubUrl", "/+$", ""), F.lit("/subtree/"), "hash").alias("url"),
        readers.message_json(readers.SUBTREE_MESSAGE).alias("message"), F.col("attemptCount").alias("attempt"), F.lit(None).cast("binary").alias("data"),
    )
    outcome = retried(wanted, int(o["subtree.maxAttempts"]), whole_hashes, **fetch)

    def handle(batch: DataFrame, batch_id: int) -> None:
        done = batch.where("state = 'done'").select(F.col("key").alias("subtree"), "data")
        if o["storageMode"] == "realtime":
            blobs.put(done.select(F.col("subtree").alias("key"), "data"), f"{topics.path}/blobs", batch_id)
        leaves = readers.split_hashes(done).select("subtree", "leaf_index", "txid")
        last = leaves.groupBy("subtree", "txid").agg(F.max("leaf_index").alias("leaf_index"))
        found = table.lookup(last)
        topics.put(found, "found", "subtree", batch_id)  # looked up once
        found = topics.spark.read.parquet(f"{topics.path}/found/from=subtree/batch={batch_id}")
        topics.send(seen.messages(found, "SEEN_ON_NETWORK"), "subtree", batch_id)
        topics.put(found.select("txid", F.col("subtree").alias("subtree_id"), F.current_timestamp().alias("ts")).distinct(), "seen", "subtree", batch_id)
        topics.put(batch.where("state = 'dlq'").select("key", "message", "attempt", "error"), "subtree_dlq", "subtree", batch_id)

    return _started(outcome, lambda b, i: _cached(b, lambda c: handle(c, i)), checkpoint, trigger)


def block_handler(messages: DataFrame, topics: Topics, checkpoint: str, opts: Mapping[str, object] | None = None, trigger: dict | None = None, **fetch) -> StreamingQuery:
    """Block announcements (value: JSON; one that cannot be decoded fails the stream) to work: skip what was handled, fetch
    the block, set its counter (`counts`), then write a message for each subtree (`work`); `block_dlq`: given up."""
    o = _setting(opts)
    decoded = readers.decoded(messages, readers.BLOCK_MESSAGE, "hash", strict=True)
    base = F.regexp_replace("dataHubUrl", "/+$", "")
    wanted = decoded.select(F.col("hash").alias("key"), F.concat(base, F.lit("/block/"), "hash").alias("url"), base.alias("message"), F.lit(0).alias("attempt"), F.lit(None).cast("binary").alias("data"))
    outcome = retried(wanted, int(o["work.maxAttempts"]), whole_block, limit=hub.BLOCK_LIMIT, **fetch)

    def handle(batch: DataFrame, batch_id: int) -> None:
        done = batch.where("state = 'done'")
        blocks = readers.parsed_blocks(done.select(F.col("key").alias("block_hash"), "data"))
        blocks = blocks.join(done.select(F.col("key").alias("block_hash"), F.col("message").alias("hub")), "block_hash").where("size(subtrees) > 0")
        # the counter is there before the first work can be
        topics.put(blocks.select("block_hash", F.size("subtrees").cast("long").alias("expected"), F.lit(None).cast("long").alias("subtree_index")), "counts", "block", batch_id)
        work = blocks.select("block_hash", "height", "hub", F.posexplode("subtrees").alias("subtreeIndex", "subtreeHash"))
        topics.put(work.select(F.col("block_hash").alias("blockHash"), F.col("height").alias("blockHeight"), "subtreeHash", "subtreeIndex", F.col("hub").alias("dataHubUrl"), F.lit(0).alias("attemptCount")), "work", "block", batch_id)
        topics.put(batch.where("state = 'dlq'").select("key", "message", "attempt", "error"), "block_dlq", "block", batch_id)

    return _started(outcome, lambda b, i: _cached(b, lambda c: handle(c, i)), checkpoint, trigger)


def whole_block(data: bytes) -> str | None:
    try:
        readers.parse_block(data)
    except ValueError as e:
        return str(e)
    return None


WORK = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in readers.SUBTREE_WORK)


def work_source(topics: Topics, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Subtree work (`work`) with the data that the blob store has at hand, as `wanted`: read store first, hub later."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        key = F.concat_ws("/", "blockHash", "subtreeIndex", "subtreeHash")
        url = F.concat(F.regexp_replace("dataHubUrl", "/+$", ""), F.lit("/subtree/"), "subtreeHash")
        have = blobs.latest(topics.spark, f"{topics.path}/blobs").select(F.col("key").alias("subtreeHash"), "data")
        rows = batch.withColumn("message", readers.message_json(readers.SUBTREE_WORK, readers.ALWAYS["SUBTREE_WORK"]))
        topics.put(rows.join(have, "subtreeHash", "left").select(key.alias("key"), url.alias("url"), "message", F.col("attemptCount").alias("attempt"), "data"), "wanted", "work", batch_id)

    return _started(topics.stream("work", WORK), handle, checkpoint, trigger)


def work_handler(table: RegistrationTable, topics: Topics, checkpoint: str, opts: Mapping[str, object] | None = None, trigger: dict | None = None, height: int = merkle.MAX_HEIGHT, expires_at: str | None = None, first_batch: int = 0, **fetch) -> StreamingQuery:
    """Subtree work (`wanted`) to proofs: fetch what is not at hand, look up, build, and write for each subtree

    * `proofs` (stump_ref, stump_hex) and `callback`: a STUMP message a url; * `counts`: the subtree is finished, also if it
    was given up (`work_dlq`); * the expiry of the txids that the block holds (expires_at), in the table's batches from
    first_batch on; * `blobs`: what had to be fetched, in storage mode `realtime`."""
    o = _setting(opts)
    outcome = retried(topics.stream("wanted", WANTED), int(o["work.maxAttempts"]), whole_hashes, **fetch)
    place = F.from_json("message", readers.SUBTREE_WORK)

    def handle(batch: DataFrame, batch_id: int) -> None:
        each = batch.withColumn("w", place).select("key", "message", "state", "attempt", "error", "data", "fetched", F.col("w.blockHash").alias("block_hash"), F.coalesce("w.blockHeight", F.lit(0)).alias("height"), F.coalesce("w.subtreeIndex", F.lit(0)).cast("long").alias("subtree_index"), F.col("w.subtreeHash").alias("subtree"))
        done = each.where("state = 'done'")
        if o["storageMode"] == "realtime":
            blobs.put(done.where("fetched").select(F.col("subtree").alias("key"), "data", "height").dropDuplicates(["key"]), f"{topics.path}/work_blobs", batch_id, "height")
        leaves = readers.split_hashes(done.select("block_hash", "height", "subtree_index", "data")).select("block_hash", "height", "subtree_index", F.col("leaf_index").cast("long").alias("leaf_index"), "raw_hex", "txid")
        who = table.lookup(leaves.select("txid").distinct()).select("txid", "url", "token")
        topics.put(who, "found", "work", batch_id)
        who = topics.spark.read.parquet(f"{topics.path}/found/from=work/batch={batch_id}")
        rows = merkle.provable(merkle.subtree_rows(leaves, who, "txid"))
        made = merkle.with_stump(merkle.with_proof(merkle.with_levels(rows, height))).drop("levels", "hashes", "nodes")
        topics.put(made, "proofs", "work", batch_id)
        made = topics.spark.read.parquet(f"{topics.path}/proofs/from=work/batch={batch_id}")
        stumps = merkle.callbacks_of(made)
        topics.send(stumps.select(F.col("url").alias("callbackUrl"), F.coalesce("token", F.lit("")).alias("callbackToken"), F.lit("STUMP").alias("type"), F.col("block_hash").alias("blockHash"), F.col("subtree_index").cast("int").alias("subtreeIndex"), F.col("stump_ref").alias("stumpRef")), "work", batch_id)
        if expires_at is not None:
            table.touch(who.select("txid"), first_batch + batch_id, expires_at)
        topics.put(each.where("state = 'dlq'").select("key", "message", "attempt", "error"), "work_dlq", "work", batch_id)
        # last: the countdown may go on as soon as these lie there
        topics.put(each.select("block_hash", F.lit(None).cast("long").alias("expected"), "subtree_index"), "counts", "work", batch_id)

    return _started(outcome, lambda b, i: _cached(b, lambda c: handle(c, i)), checkpoint, trigger)


def block_countdown(urls: Callable[[], DataFrame], topics: Topics, checkpoint: str, ttl_seconds: int = 600, trigger: dict | None = None) -> StreamingQuery:
    """`callback`: BLOCK_PROCESSED to every active url (url, token; read anew for each batch) once a block's `counts` are done."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        every = batch.select("block_hash").crossJoin(urls().select("url", "token"))  # every pair is a message
        topics.send(every.select(F.col("url").alias("callbackUrl"), F.coalesce("token", F.lit("")).alias("callbackToken"), F.lit("BLOCK_PROCESSED").alias("type"), F.col("block_hash").alias("blockHash")), "countdown", batch_id)

    return _started(counted_down(topics.stream("counts", COUNTS), ttl_seconds), lambda b, i: _cached(b, lambda c: handle(c, i)), checkpoint, trigger)
