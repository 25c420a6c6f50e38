"""Rules of the operators that the oracle's data does not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from txloom.functions import scalars as S
from txloom.operators import blocks as B
from txloom.operators import delivery as D
from txloom.operators import registry as R
from txloom.operators import seen as N
from txloom.sources import blobs, readers

NOW = "2024-01-01 00:00:00"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_registration_keeps_known_urls_past_the_cap(spark):
    e = spark.createDataFrame([("t", f"u{i}", "a", i) for i in range(5)] + [("t", "u0", "new", 9), ("T", "u0", "x", 10)], "txid string, url string, token string, seq int")
    got = R.capped(R.latest_registrations(e), 3).select("txid", "url", "token")
    assert rows(got) == [("T", "u0", "x"), ("t", "u0", "new"), ("t", "u1", "a"), ("t", "u2", "a")]
    assert R.over_cap(R.latest_registrations(e), 3).count() == 2


def test_lookup_takes_the_last_leaf_and_exact_case(spark):
    leaves = spark.createDataFrame([(1, "b", 0, 0, "aa"), (1, "b", 0, 3, "aa"), (1, "b", 0, 1, "bb")], "height long, block_hash string, subtree_index long, leaf_index long, txid string")
    regs = spark.createDataFrame([("aa", "u", ""), ("BB", "u", "")], "txid string, url string, token string")
    assert rows(R.lookup(leaves, regs).select("txid", "leaf_index")) == [("aa", 3)]


def test_expiry_at_equality(spark):
    at = dt.datetime(2024, 1, 1)
    p = spark.createDataFrame([("a", at), ("b", at - dt.timedelta(seconds=1)), ("c", None)], "txid string, expires_at timestamp_ntz")
    kids = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", "u")], "txid string, url string")
    kept, children = R.swept(p, kids, NOW)
    assert {r["txid"] for r in kept.collect()} == {r["txid"] for r in children.collect()} == {"a", "c"}
    m = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "dedup_key string")
    assert {r[0] for r in D.undelivered(m, p.withColumnRenamed("txid", "dedup_key"), NOW).collect()} == {"a", "b", "d"}


def test_recorded_conflict_overwrites_with_null(spark):
    r = spark.createDataFrame([("k", dt.datetime(2024, 1, 1), 1), ("k", None, 2)], "dedup_key string, expires_at timestamp_ntz, seq int")
    assert rows(D.recorded(r)) == [("k", None)]


def test_dual_shape_entries(spark):
    assert spark.createDataFrame([("",), ('{"t": "x"}',), ('{"u": ""}',)], "v string").where(R.entry(F.col("v")).isNull()).count() == 3
    e = spark.createDataFrame([("https://a",), ('{"u": "https://b", "t": "x"}',), ('{"u": "https://c"}',)], "v string").select(R.entry(F.col("v")).alias("e")).select("e.*")
    assert rows(e) == [("https://a", ""), ("https://b", "x"), ("https://c", "")]


def test_fires_once_however_far_the_count_goes(spark):
    o = spark.createDataFrame([("t", f"s{i}", dt.datetime(2024, 1, 1 + i)) for i in range(6)] + [("t", "s0", dt.datetime(2024, 2, 1))], "txid string, subtree_id string, ts timestamp_ntz")
    assert rows(N.fired(o, 3).select("txid", "subtree_id")) == [("t", "s2")]
    assert N.fired(o, 7).count() == 0


def test_chunks_are_sorted_and_bounded(spark):
    f = spark.createDataFrame([(f"t{i:03d}", "u") for i in range(25)], "txid string, url string")
    got = N.chunked(f, 10).orderBy("chunk").collect()
    assert [len(r["txids"]) for r in got] == [10, 10, 5]
    assert [t for r in got for t in r["txids"]] == [f"t{i:03d}" for i in range(25)]


def test_countdown_counts_each_subtree_once_and_missing_counters_emit(spark):
    e = spark.createDataFrame([("a", 2), ("b", 2)], "block_hash string, expected long")
    f = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("b", 0), ("c", 0)], "block_hash string, subtree_index long")
    assert {r["block_hash"]: r["remaining"] for r in B.countdown(e, f).collect()} == {"a": 0, "b": 1, "c": 0}


def test_attempt_limits_differ_by_one(spark):
    df = spark.range(1, 12).select(F.col("id"), D.work_state(F.lit(False), F.col("id"), 10).alias("w"), D.callback_state(F.lit(False), F.lit(False), F.col("id"), 10).alias("c"))
    got = {r["id"]: (r["w"], r["c"]) for r in df.collect()}
    assert got[8] == ("retry", "retry") and got[9] == ("dlq", "retry") and got[10] == ("dlq", "dlq")
    assert spark.range(1).select(D.callback_state(F.lit(False), F.lit(True), F.lit(0))).head()[0] == "dlq"


def test_missing_proof_is_permanent(spark):
    m = spark.createDataFrame([("r1",), ("r2",), (None,)], "stump_ref string")
    s = spark.createDataFrame([("r1", "00")], "stump_ref string, stump_hex string")
    assert {r["stump_ref"]: r["permanent"] for r in D.with_stump(m, s).collect()} == {"r1": False, "r2": True, None: False}


def test_payload_leaves_out_zero_and_empty(spark):
    p = D.payload(F.lit("STUMP"), F.lit(""), F.array().cast("array<string>"), F.lit("b"), F.lit(0), F.lit("00"))
    assert spark.range(1).select(p).head()[0] == '{"type":"STUMP","blockHash":"b","stump":"00"}'


@pytest.mark.parametrize(
    ("url", "private", "want"),
    [
        ("", False, "empty url"), ("ftp://a.b/", False, "unsupported scheme"), ("http:///x", False, "missing host"), ("http://u@a.b/", False, "userinfo not allowed"),
        ("http://METADATA/", True, "blocked host"), ("http://169.254.169.254/", True, "blocked host"), ("http://10.0.0.1/", False, "blocked address"), ("http://10.0.0.1/", True, None),
        ("http://0.0.0.0/", True, "blocked address"), ("http://224.0.0.1/", True, "blocked address"), ("http://172.16.0.1/", False, "blocked address"), ("http://172.32.0.1/", False, None),
        ("http://[::1]/", False, "blocked address"), ("http://[::1]/", True, None), ("http://[fc00::1]:80/", False, "blocked address"), ("http://[::ffff:10.0.0.1]/", False, "blocked address"),
        ("http://[fd00:ec2::254]/", True, "blocked host"), ("http://[2001:db8::1]/", False, None), ("http://[::]/", True, "blocked address"), ("http://[ff02::1]/", True, "blocked address"), ("http://[::ffff:8.8.8.8]/", False, None),
        ("http://100.64.0.1/", False, None), ("https://subscriber.example:8080/cb", False, None),
    ],
)
def test_url_guard(spark, url, private, want):
    assert spark.createDataFrame([(url,)], "u string").select(S.url_error("u", private)).head()[0] == want


def test_ip_guard_of_both_families(spark):
    cases = {"1::2::3": True, "1:2:3:4:5:6:7": True, "1:2:3:4:5:6:7:8": False, "1:2:3:4:5:6:7::": False, "12345::": True, "::127.0.0.1": False, "fe80::1%eth0": True, "[::1]": True, "": True, "::1": True, "fe80::1": True, "fc00::1": True, "2001:db8::1": False, "::": True, "febf::": True, "fec0::": False, "fdff::1": True, "fe00::1": False, "8.8.8.8\n": True, "ff02::1": True, "8.8.8.8": False, "192.168.1.1": True, "x": True, "::ffff:10.0.0.1": True}
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert {r["a"]: r["b"] for r in df.withColumn("b", S.blocked_ip(F.col("a"))).collect()} == cases
    local = {r["a"]: r["b"] for r in df.withColumn("b", S.blocked_ip(F.col("a"), True)).collect()}
    assert local["::1"] is False and local["192.168.1.1"] is False and local["::"] is True and local["ff02::1"] is True


def test_keys_follow_their_kind(spark):
    df = spark.createDataFrame(
        [("STUMP", "s", "b", 3, "", [], "u"), ("STUMP", "", "b", 0, "", [], "u"), ("BLOCK_PROCESSED", "", "b", 0, "", [], "u"), ("SEEN", "", "", 0, "t", [], "u"), ("SEEN", "", "", 0, "", ["y", "x"], "u"), ("SEEN", "", "", 0, "", [], "u")],
        "kind string, subtree string, block string, i int, txid string, txids array<string>, url string",
    )
    got = df.select(S.partition_key("kind", "subtree", "block", "i", "url"), S.idempotency_key("kind", "block", "i", "txid", "txids")).collect()
    import hashlib

    h = hashlib.sha256(b"x,y").hexdigest()[:16]
    assert [tuple(r) for r in got] == [("s|u", "b:3:STUMP"), ("b#0|u", "b:0:STUMP"), ("b|u", "b:BLOCK_PROCESSED"), ("u", "t:SEEN"), ("u", f"{h}:SEEN"), ("u", "")]


def test_readers(spark, tmp_path):
    good = "ab" * 32
    (tmp_path / "t.txt").write_text(f"# head\n\n  {good} \nnope\n")
    ok, bad = readers.txid_lines(spark, str(tmp_path / "t.txt"))
    assert [r[0] for r in ok.collect()] == [good] and [r[0] for r in bad.collect()] == ["nope"]
    (tmp_path / "00.bin").write_bytes(bytes(range(64)))
    split = readers.split_hashes(readers.blobs(spark, str(tmp_path / "*.bin"))).collect()
    assert [(r["name"], r["leaf_index"]) for r in split] == [("00.bin", 0), ("00.bin", 1)]
    assert split[0]["txid"] == bytes(range(31, -1, -1)).hex()
    m = spark.createDataFrame([('{"hash":"h","extra":1}',), ("garbage",), (None,)], "value string")
    assert [r["hash"] for r in readers.decoded(m, readers.SUBTREE_MESSAGE, "hash").collect()] == ["h"]
    with pytest.raises(Exception):
        readers.decoded(m, readers.BLOCK_MESSAGE, "hash", strict=True).collect()
    with pytest.raises(Exception, match="whole number"):
        readers.split_hashes(spark.createDataFrame([(bytes(33),)], "data binary")).collect()
    keys = {"a/b": True, "": False, "/a": False, "a\\b": False, "../a": False, "a/../b": False, "a..b": True}
    got = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {r["k"]: r["s"] for r in got.withColumn("s", readers.safe_key("k")).collect()} == keys


def test_hub_fetch_and_post(spark, tmp_path):
    import http.server
    import threading

    from txloom.sources import hub

    got, fail = [], {"flaky": 1}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            name = self.path.rsplit("/", 1)[1]
            if fail.get(name, 0) > 0:
                fail[name] -= 1
                self.send_response(503)
                self.end_headers()
            elif name == "none":
                self.send_response(404)
                self.end_headers()
            else:
                self.send_response(200)
                self.end_headers()
                self.wfile.write(name.encode())

        def do_POST(self):
            got.append((self.path, self.headers["X-Idempotency-Key"], self.headers["Authorization"], self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(204 if self.path == "/ok" else 500)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    want = spark.createDataFrame([(base, "a"), (base, "none"), (base, "flaky")], "base string, subtree_hash string")
    made = {r["subtree_hash"]: (r["data"], r["error"]) for r in hub.fetched(want, first_wait=0.01, allow_private=True).collect()}
    assert made == {"a": (b"a", None), "none": (None, "not found"), "flaky": (b"flaky", None)}
    assert hub.post(f"{base}/ok", "{}", "k", "tok", allow_private=True) and not hub.post(f"{base}/no", "{}", None, None, allow_private=True)
    assert not hub.post(f"{base}/ok", "{}", "k", "tok") and len(got) == 2  # the dialled address is checked too
    assert got[0] == ("/ok", "k", "Bearer tok", b"{}")
    m = spark.createDataFrame([(f"{base}/ok", "", "k", "{}")], "callback_url string, token string, idempotency_key string, payload string")
    assert [(r["ok"], r["permanent"]) for r in hub.posted(m).collect()] == [(False, True)]
    with pytest.raises(hub.Failed):
        hub.fetch(f"{base}/aaaa", limit=2, first_wait=0.01, allow_private=True)
    with pytest.raises(hub.Refused):
        hub.fetch(f"{base.replace('127.0.0.1', 'localhost')}/a")
    assert {r["error"] for r in hub.fetched(want).collect()} == {"blocked address"}
    again = m.withColumn("permanent", F.lit(True))
    assert [(r["ok"], r["permanent"]) for r in hub.posted(again, allow_private=True).collect()] == [(False, True)]
    # the store is asked first, and what was fetched is stored
    store = str(tmp_path / "store")
    blobs.put(spark.createDataFrame([("a", b"stored")], "key string, data binary"), store, 0)
    have = {r["subtree_hash"]: bytes(r["data"]) for r in blobs.with_remote(spark, want, store, 1, first_wait=0.01, allow_private=True).collect()}
    assert have == {"a": b"stored", "flaky": b"flaky"}
    assert {r["key"] for r in blobs.latest(spark, store).collect()} == {"a", "flaky"}
    server.shutdown()


@pytest.mark.parametrize(("address", "private", "ok"), [("8.8.8.8", False, True), ("10.0.0.1", False, False), ("10.0.0.1", True, True), ("::1", False, False), ("0.0.0.0", True, False), ("ff02::1", True, False), ("::ffff:127.0.0.1", False, False), ("fe80::1%eth0", False, False), ("name.example", True, False), ("2001:db8::1", False, True)])
def test_dial_guard(address, private, ok):
    from txloom.sources import hub

    if ok:
        hub.check_dial(address, private)
    else:
        with pytest.raises(hub.Refused):
            hub.check_dial(address, private)


def block_bytes(subtrees, height, count):
    def number(n):
        return bytes([n]) if n < 0xFD else b"\xfd" + n.to_bytes(2, "little") if n < 1 << 16 else b"\xfe" + n.to_bytes(4, "little")

    head = (1).to_bytes(4, "little") + bytes(range(32)) + bytes(32) + (1_700_000_000).to_bytes(4, "little") + bytes.fromhex("ffff001d") + (7).to_bytes(4, "little")
    coinbase = (1).to_bytes(4, "little") + number(1) + bytes(36) + number(3) + b"abc" + bytes(4) + number(1) + bytes(8) + number(2) + b"xy" + bytes(4)
    return head + number(count) + number(1000) + number(len(subtrees)) + b"".join(subtrees) + coinbase + number(height)


def test_binary_blocks(spark):
    data = block_bytes([bytes([i]) * 32 for i in range(3)], 800_123, 70_000)
    rows = [("a", data), ("b", data[:90]), ("c", None), ("d", data[:-1])]
    got = {r["block_hash"]: r for r in readers.parsed_blocks(spark.createDataFrame(rows, "block_hash string, data binary")).collect()}
    assert (got["a"]["height"], got["a"]["transaction_count"], len(got["a"]["subtrees"]), got["a"]["bits"], got["a"]["error"]) == (800_123, 70_000, 3, "1d00ffff", None)
    assert got["a"]["hash_prev_block"] == bytes(range(31, -1, -1)).hex()
    assert all(got[k]["error"] and got[k]["height"] is None for k in "bcd")


def test_blob_store(spark, tmp_path):
    path = str(tmp_path / "blobs")
    assert blobs.latest(spark, path).count() == 0
    b = lambda rows: spark.createDataFrame(rows, "key string, data binary, height long")
    blobs.put(b([("a", b"1", 100), ("b", b"2", 0), ("c", b"3", None)]), path, 0, "height")
    blobs.put(b([("a", b"4", 100)]), path, 1, "height")
    blobs.put(b([("a", b"4", 100)]), path, 1, "height")  # a replay
    blobs.delete(spark.createDataFrame([("b",), ("unheard",)], "key string"), path, 2)
    assert rows(blobs.latest(spark, path).select("key", "data", "delete_at_height")) == [("a", bytearray(b"4"), 110), ("c", bytearray(b"3"), None)]
    assert [r["key"] for r in blobs.latest(spark, path, 110).collect()] == ["c"]
    blobs.compacted(spark, path, str(tmp_path / "new"), 110)
    assert [r["key"] for r in blobs.latest(spark, str(tmp_path / "new")).collect()] == ["c"]
    with pytest.raises(Exception, match="unsafe blob key"):
        blobs.put(b([("../x", b"", 0)]), path, 3)


def test_messages_are_written_as_they_are_read(spark):
    a = spark.createDataFrame([("h", 7, "00", "01", "http://x", "p", "c"), ("g", 8, None, "", "", "", "")], "hash string, height long, header string, coinbase string, dataHubUrl string, peerId string, clientName string")
    made = readers.block_messages(a).collect()
    assert (made[0]["key"], made[0]["value"]) == ("h", '{"hash":"h","height":7,"header":"00","coinbase":"01","dataHubUrl":"http://x","peerId":"p","clientName":"c"}')
    assert made[1]["value"] == '{"hash":"g","height":8,"header":"","coinbase":"","dataHubUrl":"","peerId":"","clientName":""}'
    assert [r["value"] for r in readers.subtree_messages(a.limit(1)).collect()] == ['{"hash":"h","dataHubUrl":"http://x","peerId":"p","clientName":"c"}']
    w = spark.createDataFrame([("b", 0, "s", 0, "u", 0), ("b", 1, "s", 2, "u", 3)], "blockHash string, blockHeight long, subtreeHash string, subtreeIndex int, dataHubUrl string, attemptCount int")
    assert [r["value"] for r in readers.work_messages(w).collect()] == ['{"blockHash":"b","blockHeight":0,"subtreeHash":"s","subtreeIndex":0,"dataHubUrl":"u"}', '{"blockHash":"b","blockHeight":1,"subtreeHash":"s","subtreeIndex":2,"dataHubUrl":"u","attemptCount":3}']
    c = spark.createDataFrame([("u", "", "STUMP", "", [], "b", "", 0, "r", 0, None)], readers.CALLBACK_MESSAGE)
    assert readers.callback_messages(c).head()[0] == '{"callbackUrl":"u","type":"STUMP","blockHash":"b","stumpRef":"r"}'
    back = readers.decoded(readers.work_messages(w), readers.SUBTREE_WORK, "blockHash")
    assert [r["attemptCount"] for r in back.collect()] == [None, 3]


def test_cap_refuses_new_urls_only(spark):
    known = spark.createDataFrame([("ab" * 32, "https://a.example/")], "txid string, url string")
    asked = spark.createDataFrame([("ab" * 32, f"https://{h}.example/", "", i) for i, h in enumerate("bacb")] + [("cd" * 32, "https://z.example/", "", 9), ("xx", "https://z.example/", "", 10)], "txid string, callbackUrl string, callbackToken string, seq int")
    got = {(r["seq"]): (r["status"], r["error"]) for r in R.admitted(R.validate_watch(asked), known, 2).collect()}
    assert [got[i][0] for i in (0, 1, 2, 3, 9, 10)] == [200, 200, 429, 200, 200, 400] and got[2][1] == R.OVER_CAP


def test_empty_scopes_are_no_duplicates(spark):
    df = spark.createDataFrame([("s", "u"), ("", "u"), (None, "u")], "s string, u string").withColumn("dedup_key", S.dedup_key("s", "u", F.lit("K")))
    assert [r["dedup_key"] is None for r in df.collect()] == [False, True, True]
    done = df.select("dedup_key").withColumn("expires_at", F.lit(None).cast("timestamp_ntz"))
    assert rows(D.undelivered(df, done, NOW).select("s")) == [("",), (None,)]


def test_options_and_small_scalars(spark, tmp_path):
    from txloom.sources import options

    (tmp_path / "o.json").write_text('{"seenThreshold": 4, "callback": {"maxRetries": "7"}, "unknown": 1}')
    got = options.load(str(tmp_path / "o.json"), {"TXLOOM_SEENTHRESHOLD": "9", "TXLOOM_API_ALLOWPRIVATECALLBACKIPS": "true"})
    assert (got["seenThreshold"], got["callback.maxRetries"], got["api.allowPrivateCallbackIps"], got["storageMode"]) == (9, 7, True, "realtime")
    cases = {"90s": 90, "5m": 300, "24h": 86400, "0s": 7, "x": 7, "-1s": 7, "1h30m": 5400, "250ms": 0.25, "1.5h": 5400, "3µs": 3e-6, "90": 7, "1h ": 7}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["s"] for r in df.withColumn("s", S.seconds_or("t", 7)).collect()} == cases
    sizes = spark.createDataFrame([(5,), (2048,), (5 << 20,), (3 << 30,)], "n long").select(S.size_text("n")).collect()
    assert [r[0] for r in sizes] == ["5 B", "2.0 KB", "5.0 MB", "3.0 GB"]
    assert spark.range(1).select(S.snippet(F.repeat(F.lit("a"), 9999))).head()[0] == "a" * 256
    assert spark.range(1).select(S.snippet(F.repeat(F.lit("aé"), 9999), 4096, 5)).head()[0] == "aéa\ufffd"
    both = spark.range(1).select(S.bytes_or_none(F.lit("0aff")), S.bytes_or_none(F.lit("Cv8="))).head()
    assert bytes(both[0]) == bytes(both[1]) == b"\x0a\xff"


@pytest.mark.parametrize("kind", ["double", "long", "int", "decimal(20,2)"])
def test_percentiles_by_selection(spark, monkeypatch, kind):
    import math
    import random

    rng = random.Random(3)
    monkeypatch.setattr(D, "PARTS", 4)  # many rounds
    cases = [[5], [1, 2], [7] * 50 + [9], [rng.randrange(-1000, 1000) for _ in range(300)], [0, 10**9], [int(math.exp(rng.random() * 20)) for _ in range(101)], list(range(100))]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v long").select(F.col("v").cast(kind).alias("v"))
        got = D.percentiles(df, "v", (0.5, 0.95, 0.99, 1.0)).head()
        s = sorted(values)
        assert [int(x) for x in got] == [len(s), s[0], s[-1], *[s[max(1, math.ceil(p * len(s) / 100)) - 1] for p in (50, 95, 99, 100)]]
    assert tuple(D.percentiles(spark.createDataFrame([], "v double"), "v").head()) == (0, None, None, None, None, None)


def test_percentiles_of_odd_doubles(spark):
    values = [float("nan"), -1.7e308, 1.7e308, 5e-324, 0.0, 1.0, 1.0000000000000002, None]
    got = D.percentiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", (0.5, 0.7, 1.0)).head()
    assert tuple(got) == (6, -1.7e308, 1.7e308, 5e-324, 1.0000000000000002, 1.7e308)
