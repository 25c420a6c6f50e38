"""The handlers end to end over a hub that fails: retries by timers, dead letters, countdown, replays."""

import hashlib
import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F
from test_operators import block_bytes

from txloom.operators import merkle
from txloom.sources import blobs, readers
from txloom.sources.regtable import RegistrationTable
from txloom.streaming import handlers

FETCH = {"allow_private": True, "first_wait_ms": 50}
OFTEN = {"processingTime": "200 milliseconds"}


def leaf(s, i):
    return hashlib.sha256(f"{s}/{i}".encode()).digest()


def shown(h):
    return h[::-1].hex()


@pytest.fixture
def hub():
    """Objects by path; `fail` says how often a path fails first (-1: always)."""
    objects, fail, calls = {}, {}, {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            calls[self.path] = calls.get(self.path, 0) + 1
            if fail.get(self.path, 0):
                fail[self.path] -= 1
                self.send_response(503)
                self.end_headers()
                return
            data = objects.get(self.path)
            self.send_response(200 if data is not None else 404)
            self.send_header("Content-Length", str(len(data or b"")))
            self.end_headers()
            self.wfile.write(data or b"")

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", objects, fail, calls
    server.shutdown()


def until(done, *queries, seconds=150):
    """Wait for a condition; a stream that fails fails the test."""
    end = time.time() + seconds
    while time.time() < end:
        for q in queries:
            if q.exception():
                raise AssertionError(str(q.exception())[-2000:])
        try:
            if done():
                return
        except Exception as e:  # a topic that is not there yet, or a folder that is being replaced
            if "AssertionError" in type(e).__name__:
                raise
        time.sleep(0.3)
    raise AssertionError("it took too long")


def lines(spark, path, values):
    spark.createDataFrame([(v,) for v in values], "value string").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("value string").parquet(path)


def registered(spark, path, pairs):
    table = RegistrationTable(spark, path, 2)
    table.upsert(spark.createDataFrame([(t, u, k, i) for i, (t, u, k) in enumerate(pairs)], "txid string, url string, token string, seq long"), 0, 10)
    table.compact()
    return table


def test_subtrees_with_a_failing_hub(spark, hub, tmp_path):
    base, objects, fail, calls = hub
    for s in "abc":
        objects[f"/subtree/{s}"] = b"".join(leaf(s, i) for i in range(5))
    objects["/subtree/odd"] = b"x" * 33
    fail["/subtree/b"], fail["/subtree/never"] = 2, -1
    table = registered(spark, str(tmp_path / "reg"), [(shown(leaf(s, i)), u, k) for s in "abc" for i, u, k in ((1, "u1", ""), (2, "u1", "tok"), (2, "u2", ""))])
    topics = handlers.Topics(spark, str(tmp_path / "t"))
    told = lambda s: json.dumps({"hash": s, "dataHubUrl": base + "/"})
    stream = lines(spark, str(tmp_path / "in"), [told(s) for s in ("a", "b", "never", "odd", "a")] + ["{", json.dumps({"dataHubUrl": "x"})])
    run = lambda: handlers.subtree_handler(stream, table, topics, str(tmp_path / "ck"), trigger=OFTEN, **FETCH)
    q = run()
    sent = lambda: {(r["subtreeHash"], r["callbackUrl"]): r for r in topics.read("callback").collect()}
    until(lambda: len(sent()) == 4 and topics.read("seen").count() == 4 and topics.read("subtree_dlq").count() == 2, q)
    q.stop()
    got = sent()
    assert set(got) == {(s, u) for s in "ab" for u in ("u1", "u2")}
    assert all(r["type"] == "SEEN_ON_NETWORK" and r["callbackToken"] == ("tok" if u == "u1" else "") for (_, u), r in got.items())
    assert got["a", "u1"]["txids"] == sorted(shown(leaf("a", i)) for i in (1, 2))
    assert {(r["key"], r["attempt"]) for r in topics.read("subtree_dlq").collect()} == {("never", 3), ("odd", 3)}
    assert calls["/subtree/b"] == 3 and calls["/subtree/never"] == 3 and calls["/subtree/a"] == 1
    assert {r["key"] for r in blobs.latest(spark, f"{topics.path}/blobs").collect()} == {"a", "b"}
    # the last batch is replayed, and what was handled is announced again: nothing is sent twice
    last = max(int(n) for n in os.listdir(tmp_path / "ck/commits") if n.isdigit())
    os.remove(tmp_path / f"ck/commits/{last}")
    (tmp_path / f"ck/commits/.{last}.crc").unlink(missing_ok=True)
    lines(spark, str(tmp_path / "in"), [told(s) for s in ("a", "b", "c")])
    q = run()
    until(lambda: topics.read("callback").where("subtreeHash = 'c'").count() == 2 and topics.read("seen").count() == 6, q)
    q.stop()
    assert topics.read("callback").count() == 6 and topics.read("subtree_dlq").count() == 2 and calls["/subtree/a"] == 1
    seen = {(r["txid"], r["subtree_id"]) for r in topics.read("seen").collect()}
    assert seen == {(shown(leaf(s, i)), s) for s in "abc" for i in (1, 2)}


def test_storage_mode_decides(spark, hub, tmp_path):
    base, objects, *_ = hub
    objects["/subtree/a"] = leaf("a", 0)
    topics = handlers.Topics(spark, str(tmp_path / "t"))
    table = registered(spark, str(tmp_path / "reg"), [(shown(leaf("a", 0)), "u", "")])
    q = handlers.subtree_handler(lines(spark, str(tmp_path / "in"), [json.dumps({"hash": "a", "dataHubUrl": base})]), table, topics, str(tmp_path / "ck"), {"storageMode": "none"}, OFTEN, **FETCH)
    until(lambda: topics.read("callback").count() == 1, q)
    q.stop()
    assert blobs.latest(spark, f"{topics.path}/blobs").count() == 0


def test_a_block_ends_by_a_dead_letter(spark, hub, tmp_path):
    """Announcement, work, proofs, a subtree that is never had, BLOCK_PROCESSED; then the registrations expire."""
    base, objects, fail, calls = hub
    ids = [hashlib.sha256(bytes([i])).digest() for i in range(3)]
    for k, h in enumerate(ids[:2]):
        objects[f"/subtree/{shown(h)}"] = b"".join(leaf(k, i) for i in range(4))
    objects["/block/blk"] = block_bytes(ids, 800_001, 8)
    fail[f"/subtree/{shown(ids[1])}"] = 1
    table = registered(spark, str(tmp_path / "reg"), [(shown(leaf(0, 2)), "u1", "t"), (shown(leaf(1, 0)), "u1", ""), (shown(leaf(9, 9)), "u2", "")])
    topics = handlers.Topics(spark, str(tmp_path / "t"))
    blobs.put(spark.createDataFrame([(shown(ids[0]), objects.pop(f"/subtree/{shown(ids[0])}"))], "key string, data binary"), f"{topics.path}/blobs", 0)
    urls = spark.createDataFrame([("u1", "t"), ("u2", "")], "url string, token string")
    more = {"trigger": OFTEN, **FETCH}
    ck = lambda n: str(tmp_path / "ck" / n)
    stream = lines(spark, str(tmp_path / "in"), [json.dumps({"hash": "blk", "height": 800_001, "dataHubUrl": base})] * 2)
    opts = {"work.maxAttempts": 3}
    qs = [
        handlers.block_handler(stream, topics, ck("block"), opts, **more), handlers.work_source(topics, ck("source"), OFTEN),
        handlers.work_handler(table, topics, ck("work"), opts, expires_at="2024-01-01 00:00:00", first_batch=10, **more), handlers.block_countdown(lambda: urls, topics, ck("count"), trigger=OFTEN),
    ]
    until(lambda: topics.read("callback").where("type = 'BLOCK_PROCESSED'").count() == 2, *qs)
    for q in qs:
        q.stop()
    assert {(r["callbackUrl"], r["blockHash"]) for r in topics.read("callback").where("type = 'BLOCK_PROCESSED'").collect()} == {("u1", "blk"), ("u2", "blk")}
    stumps = topics.read("callback").where("type = 'STUMP'").collect()
    assert sorted((r["subtreeIndex"], r["callbackUrl"], r["callbackToken"]) for r in stumps) == [(0, "u1", "t"), (1, "u1", "")]
    refs = {r["stump_ref"] for r in topics.read("proofs").collect()}
    assert {r["stumpRef"] for r in stumps} == refs and len(refs) == 2
    roots = merkle.stump_roots(topics.read("proofs").select("block_hash", "subtree_index", "stump_hex")).collect()
    assert all(r["error"] is None for r in roots)
    assert [(json.loads(r["message"])["subtreeHash"], r["attempt"]) for r in topics.read("work_dlq").collect()] == [(shown(ids[2]), 3)]
    assert calls["/block/blk"] == 1 and calls[f"/subtree/{shown(ids[1])}"] == 2 and f"/subtree/{shown(ids[0])}" not in calls
    table.compact("2024-01-02 00:00:00")  # what the block held has expired
    assert [r["txid"] for r in table.state().collect()] == [shown(leaf(9, 9))]


def test_countdown_keeps_state_and_lets_it_go(spark, tmp_path):
    topics = handlers.Topics(spark, str(tmp_path / "t"))
    n = 0

    def told(*rows):
        nonlocal n
        n += 1
        topics.put(spark.createDataFrame(rows, handlers.COUNTS), "counts", "test", n)

    out = str(tmp_path / "out")
    told(("b", 2, None), ("c", 1, None), ("late", 2, None))
    q = handlers._started(handlers.counted_down(topics.stream("counts", handlers.COUNTS), 6), lambda d, i: d.write.mode("append").parquet(out), str(tmp_path / "ck"), OFTEN)
    ends = lambda: sorted((r["block_hash"], r["known"]) for r in spark.read.parquet(out).collect())
    told(("b", None, 0), ("b", None, 0), ("c", None, 0), ("late", None, 0))
    until(lambda: ends() == [("c", True)], q)
    told(("b", None, 0), ("b", 2, None), ("b", None, 1))  # repeated work, and a repeated announcement
    until(lambda: ends() == [("b", True), ("c", True)], q)
    time.sleep(8)
    told(("late", None, 1), ("unheard", None, 0))  # a counter that expired, and none at all
    until(lambda: ends() == [("b", True), ("c", True), ("late", False), ("unheard", False)], q)
    q.stop()
    # what is past is not read again: a batch takes in the rows of its own files only
    assert sum(p["numInputRows"] for p in q.recentProgress) <= 12


def test_work_messages_are_decoded_as_written(spark):
    w = spark.createDataFrame([("b", 7, "s", 0, "u", 0)], readers.SUBTREE_WORK)
    row = w.select(readers.message_json(readers.SUBTREE_WORK, readers.ALWAYS["SUBTREE_WORK"]).alias("m")).select(F.from_json("m", readers.SUBTREE_WORK).alias("w")).select("w.*").head()
    assert (row["blockHash"], row["blockHeight"], row["subtreeIndex"]) == ("b", 7, 0)
