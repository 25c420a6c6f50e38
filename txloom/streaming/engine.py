"""The continuous form: the same DataFrame functions behind Structured Streaming.

A topic is a directory of parquet files or, where the session has the connector, a Kafka topic (sources.readers).
A micro-batch that fails is replayed whole from the checkpoint; sinks write one folder for each batch id and replace
it, so a replay leaves nothing twice.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from txloom.operators import delivery, registry, seen
from txloom.streaming.publish import Totals, lasting

FIRED_SCHEMA = "txid string, subtree_id string, n long"


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks take zoned timestamps only."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def deduplicated(df: DataFrame, key: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first message of each key within the delay. Bounded by time, as state must be; not by a count of keys."""
    return event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


class FireOnce(StatefulProcessor):
    """For each txid: the set of subtrees that showed it, and whether it has fired. State may have a time to live."""

    def __init__(self, threshold: int, ttl_ms: int | None = None):
        self.threshold, self.ttl_ms = threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "subtree_id string", "at boolean", self.ttl_ms)
        self.count = handle.getValueState("count", "n long, fired boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, fired = self.count.get() if self.count.exists() else (0, False)
        out = []
        for batch in rows:
            for subtree in batch.sort_values(["ts", "subtree_id"])["subtree_id"]:
                if not self.seen.containsKey((subtree,)):
                    self.seen.updateValue((subtree,), (True,))
                    n += 1
                    if n >= self.threshold and not fired:
                        fired = True
                        out.append((key[0], subtree, n))
        self.count.update((n, fired))
        if out:
            yield pd.DataFrame(out, columns=["txid", "subtree_id", "n"])

    def close(self) -> None:
        pass


def fire_once(observed: DataFrame, threshold: int = seen.THRESHOLD, ttl_ms: int | None = None) -> DataFrame:
    """txid, subtree_id, n: one row when a txid first reaches the threshold of distinct subtrees. Needs the RocksDB store."""
    return observed.groupBy("txid").transformWithStateInPandas(statefulProcessor=FireOnce(threshold, ttl_ms), outputStructType=FIRED_SCHEMA, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


def run_until_fatal(spark: SparkSession, *queries: StreamingQuery) -> None:
    """Wait until a query ends. One that fails ends all others, and its error is raised; one that is stopped ends nothing."""
    try:
        while any(q.isActive for q in queries):
            spark.streams.resetTerminated()
            for q in queries:
                if (problem := q.exception()) is not None:
                    raise problem
            spark.streams.awaitAnyTermination(1)  # raises for a query that fails meanwhile
        for q in queries:
            if (problem := q.exception()) is not None:
                raise problem
    except Exception:
        for q in queries:
            q.stop()
        raise


def sink(df: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] | None = None, waits: Sequence[float] = (0.0,), **trigger) -> StreamingQuery:
    """Write each micro-batch (after step) to path/batch=<id>, replacing what an earlier try left there; tried again after
    the waits given (publish.ANNOUNCEMENTS for announcements), and fatal after the last."""

    def write(batch: DataFrame, batch_id: int) -> None:
        lasting(lambda: (step(batch) if step else batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}"), waits)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def complete(chunks: DataFrame, kind: str, subtree: Column) -> DataFrame:
    """Chunks (seen.chunked) as messages with all that a delivery needs: callbackUrl, callbackToken, type, subtreeHash, txids."""
    return chunks.withColumnsRenamed({"url": "callbackUrl", "token": "callbackToken"}).withColumn("callbackToken", F.coalesce("callbackToken", F.lit(""))).withColumn("type", F.lit(kind)).withColumn("subtreeHash", subtree)


def seen_callbacks(leaves: DataFrame, registrations: DataFrame, path: str, checkpoint: str, chunk: int = seen.CHUNK) -> StreamingQuery:
    """SEEN_ON_NETWORK messages for a stream of subtree leaves: lookup, grouping by url and chunking in each batch.

    leaves: height, block_hash, subtree_index, leaf_index, txid. registrations is read anew for each batch.
    """

    def step(batch: DataFrame) -> DataFrame:
        found = registry.lookup(batch, registrations)
        return complete(seen.chunked(found, chunk, "block_hash", "subtree_index"), "SEEN_ON_NETWORK", F.concat_ws("/", "block_hash", "subtree_index"))

    return sink(leaves, path, checkpoint, step)


def seen_multiple(observed: DataFrame, registrations: DataFrame, path: str, checkpoint: str, threshold: int = seen.THRESHOLD, chunk: int = seen.CHUNK, ttl_ms: int | None = None) -> StreamingQuery:
    """SEEN_MULTIPLE_NODES messages for a stream of sightings (txid, subtree_id, ts): txids that reach the threshold, once
    each, by (subtree that made them reach it, url) in chunks."""

    def step(batch: DataFrame) -> DataFrame:
        found = batch.join(registrations.select("txid", "url", "token"), "txid")
        return complete(seen.chunked(found, chunk, "subtree_id", order="txid"), "SEEN_MULTIPLE_NODES", F.col("subtree_id"))

    return sink(fire_once(observed, threshold, ttl_ms), path, checkpoint, step)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def deliveries(
    spark: SparkSession, messages: DataFrame, path: str, checkpoint: str, send: Callable[[DataFrame], DataFrame], now: str | Callable[[], str] | None = None,
    limit: int = delivery.MAX_RETRIES, ttl_days: int = 1, trigger: dict | None = None, totals: Totals | None = None,
) -> StreamingQuery:
    """Deliver a stream of messages (dedup_key, retry, next_at, …): skip what was delivered, send what is due, record
    successes, put back retries with their time, and the rest on the dead-letter table.

    Tables below path, a folder a batch: `outcomes` (what became of each message: delivered, retry, dlq, waiting,
    duplicate), from which follow `delivered` (dedup_key, expires_at; by day), `queue` (all that waits after the batch) and
    `dlq`; `counters` has one row a batch. Each batch takes up the queue that the batch before left; `ticks` keeps batches
    coming while no message arrives.

    Of rows of one key in a batch one is sent; the others wait, and are duplicates once it is delivered, or sent in their turn
    if it ends as a dead letter. totals: counted while the outcomes are written (delivery_totals).

    Outcomes are written once: if a batch is replayed after that, nothing is sent again and the other tables are made from
    them anew. Records count from earlier batches only, so a replay does not meet its own. Delivery is at least once: a batch that is lost while it sends is sent again. Records older than ttl_days are not
    read; `now` may be a function, so the clock moves from batch to batch (by default the system's, in UTC)."""

    def clock() -> str:
        return now() if callable(now) else now or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")

    def judged(batch: DataFrame, batch_id: int) -> DataFrame:
        at = clock()
        time, cols = F.lit(at).cast("timestamp_ntz"), batch.columns
        rows = batch.where("not _tick").drop("_tick") if "_tick" in cols else batch
        cols = rows.columns
        before = f"{path}/queue/batch={batch_id - 1}"
        if _exists(spark, before):
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(before).select(*cols))
        ready, later = delivery.due(rows, at)
        # of rows of one key the first is sent; messages without a key are never duplicates
        named = ready.withColumn("_k", F.coalesce("dedup_key", F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))))
        first = F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("retry"), F.xxhash64(*[c for c in cols])))
        named = named.withColumn("_n", first).drop("_k")
        if _exists(spark, f"{path}/delivered"):
            since = (dt.datetime.fromisoformat(at) - dt.timedelta(days=ttl_days)).date()
            past = spark.read.schema("dedup_key string, expires_at timestamp_ntz, day date, batch long").parquet(f"{path}/delivered")
            past = past.where((F.col("batch") < batch_id) & (F.col("day") >= F.lit(since)))
            valid = past.where(F.col("expires_at") > time).select("dedup_key").distinct().withColumn("_had", F.lit(True))
            named = named.join(valid, "dedup_key", "left").withColumn("_had", F.coalesce("_had", F.lit(False)))
        else:
            named = named.withColumn("_had", F.lit(False))
        sent = send(named.where("not _had and _n = 1").select(*cols))
        state = delivery.callback_state(F.col("ok"), F.col("permanent"), F.col("retry"), limit)
        again = time + F.make_interval(secs=F.lit(delivery.BACKOFF_SECONDS) * (F.col("retry") + 1))
        sent = sent.withColumn("state", state).withColumn("next_at", F.when(F.col("state") == "retry", again).otherwise(F.col("next_at"))).withColumn("retry", (F.col("retry") + (F.col("state") == "retry").cast("int")).cast("int"))
        other = lambda df, what: df.select(*cols).withColumn("state", F.lit(what))
        out = sent.select(*cols, "state").unionByName(other(later, "waiting")).unionByName(other(named.where("_had"), "duplicate")).unionByName(other(named.where("not _had and _n > 1"), "waiting"))
        return out.withColumn("handled_at", time)

    def step(batch: DataFrame, batch_id: int) -> None:
        outcomes = f"{path}/outcomes/batch={batch_id}"
        counts = None
        if not _exists(spark, f"{outcomes}/_SUCCESS"):
            counts = (totals or delivery_totals()).watched(judged(batch, batch_id), lambda df: df.write.mode("overwrite").parquet(outcomes))
        out = spark.read.parquet(outcomes)
        put = lambda df, where: df.write.mode("overwrite").parquet(f"{path}/{where}batch={batch_id}")
        cols = [c for c in out.columns if c not in ("state", "handled_at")]
        put(out.where("state in ('retry', 'waiting')").select(*cols), "queue/")
        lasting(lambda: put(out.where("state = 'dlq'").select(*cols), "dlq/"))
        if counts is None:  # a replay after the outcomes were written: they are counted from there
            states = {r["state"]: r["count"] for r in out.groupBy("state").count().collect()}
            counts = {k: states.get(s, 0) for k, s in STATES.items()}
        if counts["processed"]:
            at = out.where("state = 'delivered'").select("handled_at").head()[0]
            expires = F.col("handled_at") + F.make_interval(days=F.lit(ttl_days))
            put(out.where("state = 'delivered' and dedup_key is not null").select("dedup_key", expires.alias("expires_at")), f"delivered/day={at.date()}/")
        put(spark.createDataFrame([tuple(counts[k] for k in STATES)], ", ".join(f"{k} long" for k in STATES)).coalesce(1), "counters/")

    return messages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: What a service counts, and the state of an outcome that it counts.
STATES = {"processed": "delivered", "retried": "retry", "failed": "dlq", "deduped": "duplicate", "waiting": "waiting"}


def delivery_totals() -> Totals:
    """The totals of a delivery service: processed, retried, failed, deduped (and waiting, summed over batches)."""
    return Totals(**{k: F.col("state") == s for k, s in STATES.items()})


def ticks(messages: DataFrame, seconds: int = 2) -> DataFrame:
    """messages with a row every few seconds (_tick is true) that only makes batches go on, so that retries fall due."""
    rate = messages.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().where(F.expr(f"value % {seconds} = 0"))
    empty = rate.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in messages.schema], F.lit(True).alias("_tick"))
    return messages.withColumn("_tick", F.lit(False)).unionByName(empty)


class Heartbeat(StreamingQueryListener):
    """Logs what each micro-batch took in, and a service's totals at most every `seconds`: a sign of life without a line a
    message."""

    def __init__(self, log: Callable[[str], None] = print, totals: Totals | None = None, seconds: float = 30.0):
        self.log, self.totals, self.seconds, self.batches, self.rows, self.last = log, totals, seconds, 0, 0, float("-inf")

    def onQueryStarted(self, event) -> None:
        self.log(f"stream {event.id} started")

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows
        self.log(f"stream {event.progress.id}: batch {event.progress.batchId}, {event.progress.numInputRows} rows, {self.rows} in all")
        if self.totals and time.monotonic() - self.last >= self.seconds:
            self.last = time.monotonic()
            self.log(", ".join(f"{v} {k}" for k, v in self.totals.sums.items()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.log(f"stream {event.id} ended: {event.exception or 'done'}")
