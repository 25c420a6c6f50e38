"""Streams give what the batch functions give."""

import os

from pyspark.sql import functions as F

from txloom.operators import registry, seen
from txloom.sources import testdata as T
from txloom.streaming import engine

SF = "/root/testdata/sf0.001"


def events(spark, tmp_path, df, files=4):
    df.repartition(files).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_fire_once(spark, tmp_path):
    o = engine.event_time(T.observations(spark, SF))
    stream = engine.fire_once(events(spark, tmp_path, o), 5)
    engine_query = stream.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={i}"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    engine_query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["txid"] for r in got.collect()) == sorted(r["txid"] for r in seen.fired(o, 5).collect())
    assert {r["n"] for r in got.collect()} == {5}


def test_dedup_within_watermark(spark, tmp_path):
    o = engine.event_time(T.observations(spark, SF))
    s = engine.deduplicated(events(spark, tmp_path, o), "subtree_id", delay="60 days").select("subtree_id")
    engine.sink(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("subtree_id").collect())
    assert got == sorted(r[0] for r in o.select("subtree_id").distinct().collect())


def test_seen_callbacks(spark, tmp_path):
    leaves = T.leaves(spark, SF).where("height < 800010")
    regs = registry.latest_registrations(T.registration_events(spark, SF))
    q = engine.seen_callbacks(events(spark, tmp_path, leaves, 1), regs, str(tmp_path / "out"), str(tmp_path / "ck"), 3)
    q.awaitTermination()
    key = lambda df, *c: sorted(map(tuple, df.select("block_hash", "subtree_index", *c, "chunk", F.array_join("txids", ",")).collect()))
    want = seen.chunked(registry.lookup(leaves, regs), 3, "block_hash", "subtree_index").withColumn("token", F.coalesce("token", F.lit("")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert key(got, "callbackUrl", "callbackToken") == key(want, "url", "token")
    assert {r["subtreeHash"] for r in got.collect()} == {f"{r['block_hash']}/{r['subtree_index']}" for r in want.collect()} and want.where("token <> ''").count()


def test_seen_multiple(spark, tmp_path):
    o = engine.event_time(T.observations(spark, SF))
    regs = o.select("txid").distinct().withColumn("url", F.lit("u")).withColumn("token", F.lit("t"))
    engine.seen_multiple(events(spark, tmp_path, o, 2), regs, str(tmp_path / "out"), str(tmp_path / "ck"), 5).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select(F.explode("txids"), "type")
    assert sorted(r[0] for r in got.collect()) == sorted(r["txid"] for r in seen.fired(o, 5).collect())
    assert {(r["type"]) for r in got.collect()} == {"SEEN_MULTIPLE_NODES"}
    whole = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["callbackUrl"], r["callbackToken"]) for r in whole} == {("u", "t")} and all(r["subtreeHash"] == r["subtree_id"] for r in whole)


def deliver(spark, tmp_path, stream, now, sent, good=("good",)):
    def send(df):
        out = df.withColumn("ok", F.coalesce(F.col("dedup_key").isin(*good), F.lit(True))).withColumn("permanent", F.lit(False))
        sent.append(sorted(str(r["dedup_key"]) for r in out.collect()))
        return out

    q = engine.deliveries(spark, stream, str(tmp_path / "out"), str(tmp_path / "ck"), send, now)
    q.awaitTermination()
    return lambda name: spark.read.parquet(str(tmp_path / "out" / name))


def batch_of(spark, tmp_path, rows):
    m = spark.createDataFrame(rows, "dedup_key string, retry int").withColumn("next_at", F.lit(None).cast("timestamp_ntz"))
    m.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(m.schema).parquet(str(tmp_path / "in"))


def test_deliveries_retry_then_dead_letter(spark, tmp_path):
    sent = []
    stream = batch_of(spark, tmp_path, [("good", 0), ("good", 0), ("bad", 0), ("worn", 5), (None, 0), (None, 0)])
    table = deliver(spark, tmp_path, stream, T.NOW, sent)
    assert sent == [["None", "None", "bad", "good", "worn"]]  # one of two equal keys, both without a key
    assert {r["dedup_key"] for r in table("delivered").collect()} == {"good"}
    assert sorted((r["dedup_key"], r["retry"], str(r["next_at"])) for r in table("queue").collect()) == [("bad", 1, "2024-02-01 00:00:30"), ("good", 0, "None")]
    assert [r["dedup_key"] for r in table("dlq").collect()] == ["worn"]
    assert [tuple(r)[:5] for r in table("counters").collect()] == [(3, 1, 1, 0, 1)]
    # the clock moves: the queue is taken up, what was delivered is skipped, and what is not due waits on
    stream = batch_of(spark, tmp_path, [("good", 0), ("new", 0)])
    table = deliver(spark, tmp_path, stream, lambda: "2024-02-01 00:00:10", sent)
    assert sent[1] == ["new"]
    stream = batch_of(spark, tmp_path, [("good", 0)])
    table = deliver(spark, tmp_path, stream, "2024-02-01 00:00:50", sent, ("bad", "new"))
    assert sent[2] == ["bad", "new"]
    assert table("queue").where("batch = 2").count() == 0
    # a day later the record has expired
    stream = batch_of(spark, tmp_path, [("good", 0)])
    deliver(spark, tmp_path, stream, "2024-02-02 00:00:01", sent)
    assert sent[3] == ["good"]


def test_replayed_deliveries_lose_no_record(spark, tmp_path):
    sent = []
    deliver(spark, tmp_path, batch_of(spark, tmp_path, [("good", 0), ("bad", 0)]), T.NOW, sent)
    os.remove(tmp_path / "ck/commits/0")
    (tmp_path / "ck/commits/.0.crc").unlink(missing_ok=True)
    table = deliver(spark, tmp_path, batch_of(spark, tmp_path, [("good", 0)]), "2024-02-01 00:00:05", sent)
    assert sent == [["bad", "good"], []]  # the replay sends nothing, and the next copy is a duplicate
    assert {r["dedup_key"] for r in table("delivered").collect()} == {"good"}
    assert {r["dedup_key"] for r in table("queue").where("batch = 1").collect()} == {"bad"}


def test_ticks_and_heartbeat(spark, tmp_path):
    stream = engine.ticks(batch_of(spark, tmp_path, [("a", 0)]))
    assert stream.columns[-1] == "_tick" and stream.isStreaming
    lines = []
    beat = engine.Heartbeat(lines.append)
    spark.streams.addListener(beat)
    deliver(spark, tmp_path, batch_of(spark, tmp_path, [("b", 0)]), T.NOW, [])
    spark.streams.removeListener(beat)
    assert any("started" in x for x in lines)


def test_the_second_of_a_key_is_sent_if_the_first_is_given_up(spark, tmp_path):
    sent = []
    stream = batch_of(spark, tmp_path, [("k", 5), ("k", 0), ("g", 0), ("g", 0)])
    table = deliver(spark, tmp_path, stream, T.NOW, sent, ("g",))
    assert sent[0] == ["g", "k"] and {r["retry"] for r in table("dlq").collect()} == {5}
    table = deliver(spark, tmp_path, batch_of(spark, tmp_path, [("x", 0)]), "2024-02-01 00:00:05", sent, ("g", "k", "x"))
    assert sent[1] == ["k", "x"]  # the second g is a duplicate now
    assert [r["dedup_key"] for r in table("outcomes").where("state = 'duplicate'").collect()] == ["g"]


def test_totals_come_without_jobs(spark, tmp_path):
    totals, lines = engine.delivery_totals(), []
    beat = engine.Heartbeat(lines.append, totals, 0.0)
    spark.streams.addListener(beat)
    stream = batch_of(spark, tmp_path, [("good", 0), ("good", 0), ("bad", 0), ("worn", 5)])
    send = lambda df: df.withColumn("ok", F.col("dedup_key") == "good").withColumn("permanent", F.lit(False))
    run = lambda s, now: engine.deliveries(spark, s, str(tmp_path / "out"), str(tmp_path / "ck"), send, now, totals=totals).awaitTermination()
    run(stream, T.NOW)
    assert totals.sums == {"processed": 1, "retried": 1, "failed": 1, "deduped": 0, "waiting": 1}
    run(batch_of(spark, tmp_path, [("good", 0)]), "2024-02-01 00:01:00")
    assert (totals.sums["processed"], totals.sums["retried"], totals.sums["failed"], totals.sums["deduped"]) == (1, 2, 1, 2)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.streams.removeListener(beat)
    assert any("processed" in x and "deduped" in x for x in lines)


def test_dedup_by_count(spark, tmp_path):
    from txloom.streaming import state

    rows = lambda *keys: spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("key string, n int").parquet(str(tmp_path / "in"))
    fail = [False]

    def run():
        def write(batch, i):
            if fail[0]:
                raise ValueError("the sink is down")
            batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={i}"))

        q = state.recent_only(stream(), "key", 3, 1).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    got = lambda: sorted((r["batch"], r["key"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    rows("a", "b", "a", None, "c")
    run()
    assert got() == [(0, "a"), (0, "b"), (0, "c")]
    rows("a", "d")  # a is known, and is not refreshed by that: d takes its place
    run()
    assert got()[3:] == [(1, "d")]
    fail[0] = True
    rows("a", "b")
    try:
        run()
    except Exception as e:
        assert "the sink is down" in str(e)
    fail[0] = False
    run()  # the batch is handled again; a took the place of b, which then took that of c
    assert got()[4:] == [(2, "a"), (2, "b")]


def test_accumulated_entries_are_drained_once(spark, tmp_path):
    from txloom.streaming import state

    put = lambda *rows: spark.createDataFrame(list(rows), state.ENTRY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    each = lambda b, u, i: (b, u, i, [f"t{i}"], f"s{i}", False)
    over = lambda b: (b, None, None, None, None, True)
    put(*[each("b", "u", i) for i in range(5)], each("b", "v", 0), each("c", "u", 0))
    put(each("b", "u", 5), over("b"))
    stream = spark.readStream.schema(state.ENTRY).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.accumulated(stream, 4).writeStream.outputMode("update").foreachBatch(lambda d, i: d.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    import time

    end = time.time() + 100
    rows = []
    while len(rows) < 3 and time.time() < end and not q.exception():
        time.sleep(0.5)
        if (tmp_path / "out").exists():
            rows = spark.read.schema(state.DRAINED).parquet(str(tmp_path / "out")).collect()
    put(over("b"))  # nothing is left of it
    time.sleep(3)
    q.stop()
    rows = spark.read.schema(state.DRAINED).parquet(str(tmp_path / "out")).collect()
    assert sorted((r["block_hash"], r["url"], r["part"], len(r["entries"])) for r in rows) == [("b", "u", 0, 4), ("b", "u", 1, 2), ("b", "v", 0, 1)]
    own = sorted((e["subtree_index"], e["txids"][0], e["stump_ref"]) for r in rows if r["url"] == "u" for e in r["entries"])
    assert own == [(i, f"t{i}", f"s{i}") for i in range(6)]


def test_publishing_lasts(spark, tmp_path):
    import pytest

    from txloom.streaming import publish

    fails, waits = [2], []

    def write(df, folder):
        if fails[0]:
            fails[0] -= 1
            df.limit(1).write.parquet(folder)  # half a batch
            raise OSError("the disk is gone")
        df.write.parquet(folder)

    log = publish.Log(spark, str(tmp_path / "log"), write)
    rows = spark.range(3)
    assert log.read("id long").count() == 0
    assert log.publish(rows, 0, (0, 0.01, 0.01)) == 3 and log.publish(rows, 0) == 0  # a replay writes nothing
    assert sorted(r[0] for r in log.read("id long").collect()) == [0, 1, 2]
    fails[0] = 99
    with pytest.raises(publish.Unpublished, match="4 tries"):
        publish.lasting(lambda: write(rows, str(tmp_path / f"x{len(waits)}")), sleep=waits.append)
    assert waits == [0.5, 1.0, 2.0] and list(log.batches()) == [0]


def test_a_failing_stream_ends_the_others(spark, tmp_path):
    import pytest

    rate = lambda: spark.readStream.format("rate").load()
    good = engine.sink(rate(), str(tmp_path / "a"), str(tmp_path / "ca"), processingTime="300 milliseconds")

    def broken(df):
        raise ValueError("it cannot be")

    bad = engine.sink(rate(), str(tmp_path / "b"), str(tmp_path / "cb"), broken, waits=(0.0, 0.1), processingTime="300 milliseconds")
    with pytest.raises(Exception, match="2 tries failed"):
        engine.run_until_fatal(spark, good, bad)
    assert not good.isActive
