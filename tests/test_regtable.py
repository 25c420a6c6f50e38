"""The registration table against a dictionary that takes the same batches, and the plans of its reads."""

import random

import pytest
from pyspark.sql import functions as F

from txloom.sources.regtable import RegistrationTable

ASKED = "txid string, url string, token string, seq long"


class Plain:
    """txid -> ({url: token}, expiry), changed one request at a time."""

    def __init__(self, cap):
        self.rows, self.cap = {}, cap

    def upsert(self, requests):
        answers = []
        for txid, url, token, seq in sorted(requests, key=lambda r: r[3]):
            if txid is None or url is None:
                answers.append((seq, 400))
                continue
            urls, expiry = self.rows.get(txid, ({}, None))
            ok = url in urls or len(urls) < self.cap
            if ok:
                urls[url] = token or ""
                self.rows[txid] = (urls, expiry)
            answers.append((seq, 200 if ok else 429))
        return sorted(answers)

    def touch(self, txids, expiry):
        for t in txids:
            if t in self.rows:
                self.rows[t] = (self.rows[t][0], expiry)

    def sweep(self, now):
        self.rows = {t: v for t, v in self.rows.items() if v[1] is None or v[1] >= now}

    def state(self):
        return sorted((t, u, k, e) for t, (urls, e) in self.rows.items() for u, k in urls.items())


def state(table):
    return sorted((r["txid"], r["url"], r["token"], r["expires_at"] and str(r["expires_at"])) for r in table.state().collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_a_dictionary(spark, tmp_path, seed):
    rng = random.Random(seed)
    table, plain = RegistrationTable(spark, str(tmp_path / "t"), 3), Plain(2)
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    for batch in range(6):
        requests = [(rng.choice(["a", "b", "c", "d", "e", None]), rng.choice(["u", "v", "w", "x", None]), rng.choice(["t1", "t2", "", None]), 100 * batch + i) for i in range(rng.randrange(9))]
        asked = spark.createDataFrame(requests, ASKED)
        answers = sorted((r["seq"], r["status"]) for r in table.upsert(asked, batch, 2).collect())
        if batch == 2:  # a replay
            answers = sorted((r["seq"], r["status"]) for r in table.upsert(asked, batch, 2).collect())
        assert answers == plain.upsert(requests)
        touched, expiry = rng.sample("abcdef", 2), rng.choice([None, at(batch), at(batch + 2)])
        table.touch(spark.createDataFrame([(t,) for t in touched], "txid string"), batch, expiry)
        plain.touch(touched, expiry)
        assert state(table) == plain.state()
        if batch in (1, 3, 4):
            table.compact(at(batch))
            plain.sweep(at(batch))
            assert state(table) == plain.state()
        if batch == 3:
            table.vacuum()
            assert len(table.versions()) == 1
        if batch == 4:
            table = RegistrationTable(spark, str(tmp_path / "t"))  # opened anew, it keeps its buckets
            assert table.versions()[-1][2] == 3 and state(table) == plain.state()


def test_lookup_merges_and_does_not_shuffle_the_base(spark, tmp_path):
    table = RegistrationTable(spark, str(tmp_path / "t"), 4)
    rows = lambda *r: spark.createDataFrame(list(r), ASKED)
    assert table.lookup(spark.createDataFrame([("a", 1)], "txid string, leaf int")).count() == 0  # no table yet
    table.upsert(rows(("a", "u", "old", 1), ("b", "u", "t", 2)), 0, 5)
    table.compact()
    table.upsert(rows(("a", "u", "new", 3), ("a", "v", "t", 4), ("c", "w", "", 5)), 1, 5)
    leaves = spark.createDataFrame([(t, i) for i, t in enumerate("abcda")], "txid string, leaf int")
    got = sorted(tuple(r) for r in table.lookup(leaves).collect())
    assert got == [("a", 0, "u", "new"), ("a", 0, "v", "t"), ("a", 4, "u", "new"), ("a", 4, "v", "t"), ("b", 1, "u", "t"), ("c", 2, "w", "")]
    assert sorted(tuple(r) for r in table.lookup(leaves, before=1).collect()) == [("a", 0, "u", "old"), ("a", 4, "u", "old"), ("b", 1, "u", "t")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (table.lookup(leaves), table.nested()):
            plan = df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
            lines = plan[1].split("\n")
            scans = [i for i, line in enumerate(lines) if "base/v=" in line or "registrations_" in line]
            assert scans
            for i in scans:  # nothing between the scan and the join that takes it moves rows
                depth, above = len(lines[i]) - len(lines[i].lstrip(" :+-")), []
                for line in reversed(lines[:i]):
                    d = len(line) - len(line.lstrip(" :+-"))
                    if d < depth:
                        depth = d
                        above.append(line)
                    if "Join" in line and above and above[-1] == line:
                        break
                assert above and "Join" in above[-1] and not [x for x in above if "Exchange" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_broken_compaction_is_made_again(spark, tmp_path):
    path = tmp_path / "t"
    table = RegistrationTable(spark, str(path), 2)
    table.upsert(spark.createDataFrame([("a", "u", "t", 1)], ASKED), 0, 5)
    broken = path / "base" / "v=0_upto=0_buckets=2"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"half")
    assert table.versions() == [] and state(table) == [("a", "u", "t", None)]
    table.compact()
    assert len(table.versions()) == 1 and state(RegistrationTable(spark, str(path))) == [("a", "u", "t", None)]


def test_blocks_set_expiries_and_the_sweep_takes_them(spark, tmp_path):
    table = RegistrationTable(spark, str(tmp_path / "t"), 2)
    table.upsert(spark.createDataFrame([("a", "u", "t", 1), ("b", "u", "t", 2)], ASKED), 0, 5)
    table.touch(spark.createDataFrame([("a",), ("zz",), (None,)], "txid string"), 1, F.lit("2024-01-01 00:30:00"))
    table.compact("2024-01-01 00:30:00")  # at equality it is still there
    assert [r[0] for r in state(table)] == ["a", "b"]
    table.compact("2024-01-01 00:30:01")
    assert [r[0] for r in state(table)] == ["b"]
    table.upsert(spark.createDataFrame([("a", "v", "t", 9)], ASKED), 2, 5)  # it starts anew, without an expiry
    assert state(table) == [("a", "v", "t", None), ("b", "u", "t", None)]


def test_the_sketch_rules_out_what_nobody_registered(spark, tmp_path):
    table = RegistrationTable(spark, str(tmp_path / "t"), 2)
    known = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("txid"), F.lit("u").alias("url"), F.lit("").alias("token"), F.col("id").alias("seq"))
    table.upsert(known.where("seq < 2000"), 0, 5)
    assert table.may_hold(F.col("txid")) is None  # no base yet
    table.compact()
    table.upsert(known.where("seq >= 2000"), 1, 5)
    asked = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("txid"), F.col("id").alias("leaf"))
    passed = [r[0] for r in asked.where(table.may_hold(F.col("txid"))).select("leaf").collect()]
    assert set(range(3000)) <= set(passed) and len(passed) < 3000 + 0.05 * 37_000
    assert sorted(r["leaf"] for r in table.lookup(asked).collect()) == list(range(3000))
    # before the join, and so before its shuffle
    plan = table.lookup(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan


def test_sketches_are_bounded():
    from txloom.operators import bloom

    assert bloom.words_for(0) == bloom.LEAST_WORDS and bloom.words_for(10_000) == 2048 and bloom.words_for(10**9) is None


def test_a_table_too_large_for_a_sketch_goes_without(spark, tmp_path, monkeypatch):
    from txloom.operators import bloom

    monkeypatch.setattr(bloom, "MOST_WORDS", 1)
    table = RegistrationTable(spark, str(tmp_path / "t"), 2)
    table.upsert(spark.createDataFrame([("a", "u", "t", 1)], ASKED), 0, 5)
    table.compact()
    assert table.may_hold(F.col("txid")) is None
    assert table.lookup(spark.createDataFrame([("a",), ("b",)], "txid string")).count() == 1
