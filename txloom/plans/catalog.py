"""Every query of the engine over the supplied tables. Its DuckDB counterpart is in oracles.py under the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txloom.functions import scalars as S
from txloom.operators import blocks as B
from txloom.operators import delivery as D
from txloom.operators import merkle as M
from txloom.operators import registry as R
from txloom.operators import seen as N
from txloom.plans.oracles import ORACLES  # noqa: F401
from txloom.sources import readers
from txloom.sources import testdata as T
from txloom.sources.options import DEFAULTS
from txloom.sources.regtable import RegistrationTable
from txloom.sources.shared import new_folder

CAP = 3
MOST_URLS = int(DEFAULTS["api.maxCallbacksPerTxid"])
HEIGHT = 6  # subtrees hold at most 64 leaves
SWEPT_AT = "1998-06-01 00:00:00"
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def registrations(spark: SparkSession, sf: str) -> DataFrame:
    """raw_hex, url, token, first_seq, txid: hashes are shown as txids after they were aggregated and joined."""
    return R.latest_registrations(T.registration_events(spark, sf), "raw_hex").withColumn("txid", S.reversed_hex("raw_hex", 32))


def bounded(spark: SparkSession, sf: str) -> DataFrame:
    """registrations of which each txid has at most MOST_URLS: what travels as one array."""
    return R.capped(registrations(spark, sf), MOST_URLS, "raw_hex")


def found(spark: SparkSession, sf: str) -> DataFrame:
    return R.lookup(T.leaves(spark, sf), registrations(spark, sf), "raw_hex").withColumn("txid", S.reversed_hex("raw_hex", 32))


def trees(spark: SparkSession, sf: str) -> DataFrame:
    """A row a subtree, with its levels."""
    return M.with_levels(M.subtree_rows(T.leaves(spark, sf)), HEIGHT)


def proofs(spark: SparkSession, sf: str) -> DataFrame:
    """A row a subtree, with its levels, who registered and the proof."""
    return M.with_proof(M.with_levels(M.provable(M.subtree_rows(T.leaves(spark, sf), bounded(spark, sf))), HEIGHT))


def stumps(spark: SparkSession, sf: str) -> DataFrame:
    return M.with_stump(proofs(spark, sf))


def levels(spark: SparkSession, sf: str) -> DataFrame:
    return M.tree_levels(T.leaves(spark, sf), HEIGHT)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return proofs(spark, sf).select("block_hash", "subtree_index", "height", "tree_height", F.inline("nodes"))


@query
def registered_by_url(spark: SparkSession, sf: str) -> DataFrame:
    """Registered txids of each (block, url), with how many subtrees they lie in."""
    f = found(spark, sf).groupBy("height", "url").agg(F.count("*").alias("n_txids"), F.count_distinct("subtree_index").alias("n_subtrees"), F.min("txid").alias("first_txid"))
    return f


@query
def registration_lookup(spark, sf):
    return found(spark, sf).select("height", "subtree_index", "leaf_index", "txid", "url", "token")


@query
def txid_display(spark, sf):
    return T.transactions(spark, sf).select("tx_key", "raw_hex", "txid")


@query
def raw_split_txids(spark, sf):
    """Subtree blobs split into hashes again."""
    blobs = M.subtree_arrays(T.leaves(spark, sf)).select("height", "subtree_index", F.unhex(F.array_join("hashes", "")).alias("data"))
    return readers.split_hashes(blobs).select("height", "subtree_index", F.col("leaf_index").cast("long").alias("leaf_index"), "raw_hex", "txid")


@query
def watch_validation(spark, sf):
    """Requests made from suppliers, good and bad by turns."""
    s = T.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    k = F.col("k") % 24
    tx = S.sha256_hex(F.concat(F.lit("tx:"), F.col("k").cast("string")))
    odd = {
        3: "", 4: "ftp://a.example/x", 5: "http://10.1.2.3/x", 6: "http://metadata/x", 7: "http://u:p@b.example/x", 8: "http://127.0.0.1:99/x", 9: "https://172.32.0.1/x",
        12: "http://[::1]/x", 13: "http://[fc00::1]:8080/x", 14: "http://[::ffff:10.0.0.1]/x", 15: "http://[fd00:ec2::254]/x", 16: "http://[2001:db8::1]/x", 17: "http://[::]/x", 18: "http://[ff02::1]/x", 19: "http://[FE80::1]/x",
        20: "http://METADATA.google.internal/x", 21: "http:///x",
    }
    url = F.lit("https://subscriber.example/cb")
    for i, u in odd.items():
        url = F.when(k == i, u).otherwise(url)
    txid = F.when(k == 1, "").when(k == 2, "xyz").when(k == 11, F.upper(tx)).when(k == 22, F.concat(tx, F.lit("\n"))).when(k == 23, F.concat(F.lit(" "), tx)).otherwise(tx)
    s = s.select("k", txid.alias("txid"), url.alias("callbackUrl"), F.when(k == 10, F.repeat(F.lit("é"), 2049)).otherwise("t").alias("callbackToken"))
    return R.validate_watch(s).select("k", F.col("status").cast("long").alias("status"), "error")


@query
def watch_bodies(spark, sf):
    """Bodies made from customers: whole, cut off, of another kind, or without a field by turns."""
    k = F.col("c_custkey") % 9
    tx = S.sha256_hex(F.concat(F.lit("tx:"), F.col("c_custkey").cast("string")))
    whole = F.concat(F.lit('{"txid":"'), tx, F.lit('","callbackUrl":"https://subscriber.example/cb","callbackToken":"t"}'))
    odd = {1: F.expr("substring(whole, 1, 40)"), 2: F.lit("[1]"), 3: F.lit('{"txid":5}'), 4: F.lit("null"), 5: F.concat(F.lit('{"txid":"'), tx, F.lit('","other":[1]}')), 6: F.lit(None).cast("string"), 7: F.lit('{"callbackUrl":"https://a.example/","txid":null}')}
    b = T.read(spark, sf, "customer").select("c_custkey", k.alias("k"), tx.alias("tx"), whole.alias("whole"))
    body = F.col("whole")
    for i, text in odd.items():
        body = F.when(F.col("k") == i, F.concat(F.lit('{"txid":"'), F.col("tx"), F.lit('","other":[1]}')) if i == 5 else text).otherwise(body)
    checked = R.validate_watch(R.requests_of(b.select("c_custkey", body.alias("body"))))
    return checked.select("c_custkey", F.col("status").cast("long").alias("status"), "error")


@query
def resolved_urls(spark, sf):
    """Urls of suppliers whose host leads to public addresses only; some lead inside, some nowhere."""
    k = F.col("s_suppkey")
    host = F.concat(F.lit("h"), (k % 50).cast("string"), F.lit(".example"))
    s = T.read(spark, sf, "supplier").select(k.alias("k"), host.alias("host"), F.concat(F.lit("https://"), host, F.lit("/cb")).alias("url"))
    inner = F.concat(F.lit("10.0.0."), (F.col("k") % 256).cast("string"))
    address = F.when(F.col("k") % 50 == 3, inner).when(F.col("k") % 50 == 4, F.lit("fd00::1")).otherwise(F.concat(F.lit("93.184."), (F.col("k") % 200).cast("string"), F.lit(".7")))
    resolution = s.where("k % 50 <> 49").select("host", address.alias("address"))
    return R.resolved_ok(s, resolution).select("k", "url")


@query
def api_lookup(spark, sf):
    """Who is registered for the order of each customer's number, tokens hidden; every seventh asks badly."""
    tx = S.reversed_hex(T.raw_hash(F.col("c_custkey")), 32)
    asked = T.read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.substring(tx, 1, 63)).otherwise(tx).alias("txid"))
    a = R.answered_lookup(asked, registrations(spark, sf))
    return a.select("c_custkey", F.col("status").cast("long").alias("status"), "error", F.array_join("urls", ",").alias("urls"))


@query
def watch_admission(spark, sf):
    """Answers to requests in their order, made from returned line items: a txid's urls over the cap are refused with 429."""
    e = T.registration_events(spark, sf).withColumn("callbackUrl", F.when(F.col("seq.l_linenumber") == 4, "ftp://x/").otherwise(F.col("url")))
    checked = R.validate_watch(e.select("txid", "callbackUrl", F.col("token").alias("callbackToken"), "seq"))
    known = T.read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(S.reversed_hex(T.raw_hash(F.col("o_orderkey")), 32).alias("txid"), F.lit("https://known.example/").alias("url"))
    out = R.admitted(checked, known, 2)
    return out.groupBy("txid", "callbackUrl").agg(F.max("status").cast("long").alias("status"), F.count("*").alias("n"), F.max("error").alias("error"))


@query
def registration_latest_token(spark, sf):
    return registrations(spark, sf).select("txid", "url", "token")


@query
def registration_cap(spark, sf):
    return R.capped(registrations(spark, sf), CAP).select("txid", "url", F.col("slot").cast("long").alias("slot"))


@query
def registration_over_cap(spark, sf):
    return R.over_cap(registrations(spark, sf), CAP).groupBy("txid").agg(F.count("*").alias("refused"))


@query
def registration_point_get(spark, sf):
    one = S.reversed_hex(T.raw_hash(F.lit(7)))
    return registrations(spark, sf).where(F.col("txid") == one).select("url", "token").orderBy("url")


@query
def registration_missing_anti(spark, sf):
    """Transactions that nobody registered for."""
    return T.transactions(spark, sf).join(registrations(spark, sf), "txid", "left_anti").select("tx_key", "txid")


@query
def registration_nested(spark, sf):
    """The set-valued form, as text."""
    n = R.nested(registrations(spark, sf))
    return n.select("txid", F.array_join(F.transform("callbacks", lambda c: F.concat(c["url"], F.lit("|"), c["token"])), ",").alias("callbacks"))


def registration_batches(spark, sf) -> list[DataFrame]:
    """Requests (txid, url, token, seq) in three batches, by line number."""
    e = T.registration_events(spark, sf)
    seq = F.datediff(F.col("seq.l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long") * 1_000_000_000 + F.col("seq.l_linenumber") * 100_000_000 + F.col("seq.l_suppkey")
    e = e.select("txid", "url", "token", F.least(F.lit(2), F.expr("(seq.l_linenumber - 1) div 2")).alias("batch"), seq.alias("seq"))
    return [e.where(F.col("batch") == b).drop("batch") for b in range(3)]


@query
def registration_table(spark, sf):
    """The table on disk after three batches with a cap: after the first the urgent orders are given an expiry, after the
    second what has expired is swept."""
    table = RegistrationTable(spark, new_folder(spark, "registrations"), 8)
    urgent = T.read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(S.reversed_hex(T.raw_hash(F.col("o_orderkey")), 32).alias("txid"), "o_orderdate")
    for i, requests in enumerate(registration_batches(spark, sf)):
        table.upsert(requests, i, CAP)
        if i == 0:
            table.touch(urgent, i, F.col("o_orderdate") + F.make_interval(days=F.lit(1)))
        if i == 1:
            table.compact(SWEPT_AT)
    return table.state()


@query
def registration_table_lookup(spark, sf):
    """The leaves of all subtrees looked up in the table on disk: a base in buckets, a log, and a sketch before the shuffle."""
    table = RegistrationTable(spark, new_folder(spark, "registrations"), 8)
    for i, requests in enumerate(registration_batches(spark, sf)):
        table.upsert(requests, i, 1000)
        if i == 1:
            table.compact()
    return table.lookup(T.leaves(spark, sf).select("height", "subtree_index", "leaf_index", "txid"))


def expiring(spark, sf):
    """txid, expires_at: users, a day after their last event; every tenth never expires."""
    e = T.read(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return e.select(F.col("user_id").cast("string").alias("txid"), F.when(F.col("user_id") % 10 != 0, F.col("ts") + F.make_interval(days=F.lit(1))).alias("expires_at"))


@query
def ttl_update(spark, sf):
    hit = T.read(spark, sf, "events").where("event_type = 'purchase' and value > 150").select(F.col("user_id").cast("string").alias("txid"))
    return R.with_ttl(expiring(spark, sf), hit, T.NOW, 1800)


@query
def ttl_sweep(spark, sf):
    children = T.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("txid"), T.url_of(F.col("event_id")).alias("url")).distinct()
    parents, kids = R.swept(expiring(spark, sf), children, "2024-01-31 12:00:00")
    return parents.join(kids.groupBy("txid").agg(F.count("*").alias("urls")), "txid", "left").select("txid", F.coalesce("urls", F.lit(0)).alias("urls"))


@query
def url_registry_upsert(spark, sf):
    return R.url_registry(T.url_sightings(spark, sf))


@query
def url_registry_active(spark, sf):
    """Users as subscribers, each at a url of its own; those whose latest token is tok-3 have no time on record."""
    e = T.read(spark, sf, "events")
    own = F.concat(F.lit("https://user-"), F.col("user_id").cast("string"), F.lit(".example/callback"))
    u = R.url_registry(e.select(own.alias("url"), F.concat(F.lit("tok-"), (F.col("event_id") % 7).cast("string")).alias("token"), F.col("ts").alias("last_seen"), F.col("event_id").alias("seq")))
    u = u.withColumn("last_seen", F.when(F.col("token") != "tok-3", F.col("last_seen")))
    return R.active_urls(u, "2024-01-31 12:00:00", 1).select("url", "token")


@query
def seen_group_by_url(spark, sf):
    g = N.by_url(found(spark, sf), "height", "subtree_index")
    return g.select("height", "subtree_index", "url", F.coalesce("token", F.lit("")).alias("token"), "n", F.sha2(F.array_join("txids", ","), 256).alias("txids_sha256"))


@query
def seen_message_json(spark, sf):
    """The encoded messages for a subtree's sightings, of at most 50 txids each, with all that a delivery needs."""
    f = found(spark, sf).withColumn("subtree", F.concat_ws("/", "block_hash", "subtree_index"))
    m = readers.whole_callbacks(N.messages(f, "SEEN_ON_NETWORK", 50))
    return m.select("subtreeHash", "callbackUrl", F.element_at("txids", 1).alias("first_txid"), readers.message_json(readers.CALLBACK_MESSAGE).alias("value"))


@query
def seen_chunked(spark, sf):
    """Runs of a subtree's txids for each url."""
    c = N.chunked(found(spark, sf), 2, "block_hash", "subtree_index")
    return c.select("block_hash", "subtree_index", "url", "chunk", F.size("txids").cast("long").alias("n"), S.txid_set_hash("txids").alias("set_hash"))


@query
def seen_distinct_count(spark, sf):
    return N.distinct_counts(T.observations(spark, sf))


@query
def seen_approx_count(spark, sf):
    return N.approximate_counts(T.observations(spark, sf))


@query
def seen_threshold_fire(spark, sf):
    return N.fired(T.observations(spark, sf)).select("txid", "subtree_id", "fired_at")


@query
def seen_threshold_fire_55(spark, sf):
    return N.fired(T.observations(spark, sf), 55).select("txid", "subtree_id", "fired_at")


@query
def seen_multiple_nodes(spark, sf):
    """Txids that just fired, by (subtree that made them fire, url)."""
    f = N.fired(T.observations(spark, sf)).withColumn("url", T.url_of(F.col("txid").cast("long"))).withColumn("token", F.lit("t"))
    g = N.by_url(f, "subtree_id", order="txid")
    return g.select("subtree_id", "url", "n", F.array_join("txids", ",").alias("txids"))


@query
def message_dedup(spark, sf):
    """The first sighting of each subtree."""
    return N.deduplicated(T.observations(spark, sf), "subtree_id").select("subtree_id", "ts", "seq")


def callback_messages(spark, sf) -> DataFrame:
    """STUMP, BLOCK_PROCESSED and SEEN messages over the blocks of the tables."""
    sub = M.subtree_arrays(T.leaves(spark, sf)).select("block_hash", "subtree_index", "subtree_hash", F.col("hashes").alias("all"))
    kinds = F.explode(F.array(*map(F.lit, ("STUMP", "BLOCK_PROCESSED", "SEEN_ON_NETWORK", "SEEN_MULTIPLE_NODES"))))
    m = sub.withColumn("type", kinds).withColumn("url", T.url_of(F.col("subtree_index")))
    stump, done, many = (F.col("type") == t for t in ("STUMP", "BLOCK_PROCESSED", "SEEN_ON_NETWORK"))
    one = ~(stump | done | many)
    return m.select(
        "type", "url",
        F.when(stump | done, F.col("block_hash")).otherwise("").alias("block"),
        F.when(done, "").when(F.col("subtree_index") % 2 == 0, F.col("subtree_hash")).otherwise("").alias("subtree"),
        F.when(stump, F.col("subtree_index")).otherwise(F.lit(0)).alias("index"),
        F.when(one, F.element_at("all", 1)).otherwise("").alias("txid"),
        F.when(many, F.col("all")).otherwise(F.array().cast("array<string>")).alias("txids"),
        F.col("block_hash"), F.col("subtree_index"),
    )


@query
def partition_key(spark, sf):
    m = callback_messages(spark, sf)
    return m.select("block_hash", "subtree_index", "type", S.partition_key("type", "subtree", "block", "index", "url").alias("partition_key"))


@query
def idempotency_key(spark, sf):
    m = callback_messages(spark, sf)
    return m.select("block_hash", "subtree_index", "type", S.idempotency_key("type", "block", "index", "txid", "txids").alias("idempotency_key"))


@query
def dedup_key(spark, sf):
    """Every third message has no scope, and so no key."""
    m = callback_messages(spark, sf)
    bare = F.col("subtree_index") % 3 == 2
    m = m.withColumn("block", F.when(~bare, F.col("block")).otherwise("")).withColumn("txid", F.when(~bare, F.col("txid")).otherwise("")).withColumn("txids", F.when(~bare, F.col("txids")).otherwise(F.array().cast("array<string>")))
    m = m.withColumn("type", F.when(bare & (F.col("type") == "STUMP"), "BLOCK_PROCESSED").otherwise(F.col("type")))
    scope = S.scope_key("type", "block", "index", "txid", "txids")
    return m.select("block_hash", "subtree_index", "type", S.dedup_key(scope, "url", "type").alias("dedup_key")).distinct()


@query
def callback_payload_json(spark, sf):
    m = callback_messages(spark, sf)
    return m.select("block_hash", "subtree_index", F.col("type").alias("kind"), D.payload(F.col("type"), F.col("txid"), F.col("txids"), F.col("block"), F.col("index"), F.lit("")).alias("payload"))


@query
def txid_set_hash(spark, sf):
    t = found(spark, sf).groupBy("block_hash", "subtree_index", "url").agg(F.collect_set("txid").alias("t"))
    return t.select("block_hash", "subtree_index", "url", S.txid_set_hash("t").alias("set_hash"))


@query
def txids_json_list(spark, sf):
    """What a url gathers of a subtree, as a JSON list in a text and read back."""
    t = found(spark, sf).groupBy("block_hash", "subtree_index", "url").agg(F.to_json(F.array_sort(F.collect_list("txid"))).alias("txids_json"))
    back = S.json_list("txids_json")
    return t.select("block_hash", "subtree_index", "url", F.sha2("txids_json", 256).alias("digest"), F.size(back).cast("long").alias("n"), F.element_at(back, -1).alias("last_txid"))


@query
def hash_partition(spark, sf):
    """Hashed keys of urls: 8 bytes in hex, and the first 4 as a signed number."""
    u = T.url_sightings(spark, sf).select("url").distinct()
    return u.select("url", S.short_hash(F.col("url")).alias("short_hash"), S.hash_int32("url").cast("long").alias("int32"))


@query
def compact_size(spark, sf):
    n = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    v = F.when(F.col("k") % 4 == 0, F.col("k") * 1_000_003).when(F.col("k") % 4 == 1, F.col("k") % 300).when(F.col("k") % 4 == 2, F.col("k") * 97).otherwise(F.col("k") * F.lit(5_000_000_007))
    return n.select("k", S.compact_size_hex(v).alias("encoded"))


@query
def backoff(spark, sf):
    p = T.read(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 9 + 1).alias("attempt"))
    return p.select("k", S.exponential_backoff_ms("attempt").alias("exponential_ms"), (F.col("attempt") * 30).alias("linear_s"))


@query
def block_fanout(spark, sf):
    sub = M.subtree_arrays(T.leaves(spark, sf))
    blocks = sub.groupBy("block_hash", "height").agg(F.expr("transform(array_sort(collect_list(struct(subtree_index, subtree_hash))), x -> x.subtree_hash)").alias("subtrees"))
    return B.fan_out(blocks).select("block_hash", "height", F.col("subtree_index").cast("long").alias("subtree_index"), "subtree_hash")


@query
def merkle_levels(spark, sf):
    return levels(spark, sf).select("height", "subtree_index", F.col("level").cast("long").alias("level"), F.col("offset").cast("long").alias("offset"), "hash")


@query
def tree_layout(spark, sf):
    """Where a drawing puts each node of each tree."""
    return M.layout(levels(spark, sf)).select("height", "subtree_index", F.col("level").cast("long").alias("level"), F.col("offset").cast("long").alias("offset"), "x", "y")


@query
def merkle_root(spark, sf):
    return trees(spark, sf).select("block_hash", "subtree_index", F.col("n").cast("long").alias("n"), M.root_of(F.col("levels"), F.col("tree_height")).alias("root"))


@query
def merkle_root_4096(spark, sf):
    """Roots, and digests of the proofs, of subtrees of up to 4,096 leaves."""
    rows = M.with_levels(M.subtree_rows(T.leaves(spark, sf, 4096), bounded(spark, sf)), 12)
    p = M.with_stump(M.with_proof(rows))
    return p.select("block_hash", "subtree_index", F.col("n").cast("long").alias("n"), M.root_of(F.col("levels"), F.col("tree_height")).alias("root"), "stump_ref")


@query
def merkle_large_subtree(spark, sf):
    """Proofs of a few leaves of subtrees of up to 262,144: 16 outputs of each order, the first ones of the dearest registered."""
    o = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    place = F.col("k") * 16 + F.col("i")
    leaf = o.select(F.lit("large").alias("block_hash"), F.shiftright(place, 18).alias("subtree_index"), F.lit(900_000).cast("long").alias("height"), (place % (1 << 18)).alias("leaf_index"), S.sha256_hex(F.concat_ws(":", F.lit("out"), "k", "i")).alias("raw_hex"), ((F.col("i") == 0) & (F.col("o_totalprice") > 499_000)).alias("own"))
    p = M.with_stump(M.chunked_proofs(leaf, leaf.where("own")))
    return p.select("subtree_index", F.col("n").cast("long").alias("n"), F.col("tree_height").cast("long").alias("tree_height"), "root", F.size("nodes").cast("long").alias("n_nodes"), "stump_ref")


@query
def stump_nodes(spark, sf):
    n = nodes(spark, sf)
    return n.select("block_hash", "subtree_index", *[F.col(c).cast("long").alias(c) for c in ("tree_height", "level", "offset", "flag")], F.coalesce("hash", F.lit("")).alias("hash"))


@query
def stump_encode_hex(spark, sf):
    return stumps(spark, sf).select("block_hash", "subtree_index", "stump_hex")


@query
def stump_ref(spark, sf):
    return stumps(spark, sf).select("block_hash", "subtree_index", "stump_ref")


@query
def stump_decode(spark, sf):
    """Proofs encoded and decoded again; equal to stump_nodes."""
    d = M.decode_stumps(stumps(spark, sf))
    return d.select("block_hash", "subtree_index", *[F.col(c).cast("long").alias(c) for c in ("tree_height", "level", "offset", "flag")], F.coalesce("hash", F.lit("")).alias("hash"))


@query
def stump_verify(spark, sf):
    """The root that each registered leaf folds to, and whether it is the tree's."""
    p = proofs(spark, sf).select("block_hash", "subtree_index", "tree_height", "nodes", M.root_of(F.col("levels"), F.col("tree_height")).alias("want"))
    v = M.verified(p, "want")
    return v.select("block_hash", "subtree_index", F.col("leaf_index").cast("long").alias("leaf_index"), (F.col("root") == F.col("want")).alias("ok"))


@query
def stump_root(spark, sf):
    """The root that each encoded proof leads to as a whole, and whether it is the tree's."""
    p = M.with_stump(proofs(spark, sf).withColumn("want", M.root_of(F.col("levels"), F.col("tree_height"))))
    r = M.stump_roots(p, ["block_hash", "subtree_index", "want"])
    return r.select("block_hash", "subtree_index", "root", (F.col("root") == F.col("want")).alias("ok"))


@query
def stump_merge(spark, sf):
    """Proofs of each url merged into the proof of all."""
    rows = M.with_levels(M.subtree_rows(T.leaves(spark, sf), bounded(spark, sf)), HEIGHT)
    own = F.transform("found", lambda x: x["leaf_index"])
    parts = (F.filter(own, lambda o: o % 2 == 0), F.filter(own, lambda o: o % 2 == 1))
    one = M.with_proof(rows, parts[0]).withColumnRenamed("nodes", "even")
    m = M.with_proof(one, parts[1]).withColumn("nodes", M.merged(F.col("even"), F.col("nodes")))
    m = m.select("block_hash", "subtree_index", "tree_height", F.inline("nodes"))
    return m.select("block_hash", "subtree_index", *[F.col(c).cast("long").alias(c) for c in ("tree_height", "level", "offset", "flag")], F.coalesce("hash", F.lit("")).alias("hash"))


@query
def stump_callbacks(spark, sf):
    c = M.callbacks_of(stumps(spark, sf))
    return c.select("block_hash", "subtree_index", "url", F.coalesce("token", F.lit("")).alias("token"), "stump_ref")


def work(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(expected subtrees of each block, finished ones: all but those whose first transaction is large and still pending)."""
    sub = T.leaves(spark, sf, T.SUBTREE_SIZE, "o_orderstatus", "o_totalprice").where("leaf_index = 0")
    expected = sub.groupBy("block_hash").agg(F.count("*").alias("expected"))
    return expected, sub.where("o_orderstatus <> 'P' or o_totalprice <= 475000").select("block_hash", "subtree_index", F.col("subtree_index").alias("finished_at"))


@query
def subtree_countdown(spark, sf):
    return B.countdown(*work(spark, sf))


@query
def running_remaining(spark, sf):
    return B.running_remaining(*work(spark, sf))


@query
def block_processed_broadcast(spark, sf):
    done = B.countdown(*work(spark, sf)).where("remaining <= 0")
    return B.broadcast_done(done, R.active_urls(R.url_registry(T.url_sightings(spark, sf)), T.NOW)).select("block_hash", "url", "token")


@query
def accumulator_drain(spark, sf):
    a = B.accumulated(found(spark, sf))
    text = F.array_join(F.transform("entries", lambda e: F.concat(e["subtree_index"].cast("string"), F.lit(":"), S.txid_set_hash(e["txids"]))), ",")
    return a.select("block_hash", "url", text.alias("entries"))


@query
def dah_prune(spark, sf):
    s = T.leaves(spark, sf).select("height", "block_hash", "subtree_index").distinct()
    s = s.withColumn("delete_at_height", F.when(F.col("subtree_index") > 0, F.col("height") + 10))
    return B.pruned(s, T.FIRST_HEIGHT + 40).select("block_hash", "subtree_index")


@query
def delivery_dedup(spark, sf):
    """Attempts whose key has no success on record within a day before the clock."""
    a = T.attempts(spark, sf).withColumn("dedup_key", S.dedup_key(F.col("key").cast("string"), "url", "event_type"))
    done = a.where("event_type = 'purchase'").groupBy("dedup_key").agg(F.max(F.col("ts") + F.make_interval(days=F.lit(1))).alias("expires_at"))
    return D.undelivered(a, done, "2024-01-30 12:00:00").groupBy("key", "url").agg(F.count("*").alias("n"))


@query
def delivery_retry_schedule(spark, sf):
    return D.scheduled(T.attempts(spark, sf)).select("key", "seq", F.col("retry").cast("long").alias("retry"), "state", "next_at")


@query
def delivery_outcome(spark, sf):
    return D.outcomes(D.scheduled(T.attempts(spark, sf)))


def failing(spark, sf) -> DataFrame:
    """Attempts that only a purchase ends, so that some messages run out of tries."""
    return T.attempts(spark, sf).withColumn("ok", F.col("event_type") == "purchase")


@query
def dlq_rows(spark, sf):
    return D.scheduled(failing(spark, sf)).where("state = 'dlq'").select("key", "url", "seq", F.col("retry").cast("long").alias("retry"))


@query
def due_messages(spark, sf):
    ready, later = D.due(D.scheduled(failing(spark, sf)), "2024-01-01 06:00:00")
    return ready.select("key", "seq").withColumn("due", F.lit(True)).unionByName(later.select("key", "seq").withColumn("due", F.lit(False)))


@query
def delivery_latency_percentiles(spark, sf):
    return D.percentiles(T.read(spark, sf, "orders"), "o_totalprice")


@query
def scale_duplicates(spark, sf):
    return D.repeated(T.registration_events(spark, sf), "txid", "url")


@query
def recent_callbacks(spark, sf):
    return D.recent(T.attempts(spark, sf), 100).select("key", "url", "seq", "ts", "ok")


@query
def receiver_report(spark, sf):
    e = T.attempts(spark, sf).withColumn("bytes", F.octet_length("event_type").cast("long"))
    return D.receiver_stats(e)


@query
def missing_and_unexpected(spark, sf):
    """Registered pairs against those that were delivered up to a height of the chain."""
    got = found(spark, sf).where(F.col("height") < T.FIRST_HEIGHT + 40).select("txid", "url")
    return D.spurious(got, registrations(spark, sf), "txid", "url").groupBy("what").agg(F.count("*").alias("n"))


@query
def exact_cover(spark, sf):
    """How many txids lie in how many subtrees, over all leaves: each should lie in one."""
    each = T.leaves(spark, sf).groupBy("raw_hex").agg(F.count("*").alias("n_leaves"), F.count_distinct("block_hash", "subtree_index").alias("n_subtrees"))
    return each.groupBy("n_leaves", "n_subtrees").agg(F.count("*").alias("n_txids"), F.min("raw_hex").alias("first_hex"))


@query
def fixture_cover(spark, sf):
    """Fixture txids, as many as there are orders, dealt over subtrees: each subtree's size and first hash."""
    n = T.read(spark, sf, "orders").count()
    r = readers.round_robin(readers.fixture_txids(spark, 42, n), 16)
    return r.groupBy("subtree_index").agg(F.count("*").alias("n"), F.count_distinct("raw_hex").alias("distinct_n"), F.min("raw_hex").alias("first_hex"))


@query
def latest_sighting_gap(spark, sf):
    """The time between a txid's repeated sightings of a subtree: what a time-bounded dedup would have to remember."""
    order = Window.partitionBy("txid", "subtree_id").orderBy("ts", "seq")
    o = T.observations(spark, sf).withColumn("before", F.lag("ts").over(order)).where("before is not null")
    return o.groupBy("subtree_id").agg(F.count("*").alias("n"), F.max(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))).alias("longest_us"))


@query
def proof_walk(spark, sf):
    w = M.proof_walk(nodes(spark, sf))
    return w.select("block_hash", "subtree_index", *[F.col(c).cast("long").alias(c) for c in ("leaf_index", "level", "own", "other")])


@query
def root_in_either_order(spark, sf):
    """Roots against their own bytes, turned round for odd subtrees and wrong for every third."""
    r = trees(spark, sf).withColumn("root", M.root_of(F.col("levels"), F.col("tree_height"))).withColumn("k", F.col("subtree_index") % 3)
    want = F.when(F.col("k") == 0, F.col("root")).when(F.col("k") == 1, S.reversed_hex("root")).otherwise(F.sha2("root", 256))
    return r.select("block_hash", "subtree_index", S.root_matches(F.col("root"), want).alias("ok"))


@query
def stump_validity(spark, sf):
    """Received proofs: as sent, of another height, missing, or of another block by turns."""
    e = stumps(spark, sf)
    k = (F.col("subtree_index") + F.col("height")) % 4
    e = e.withColumn("stump_hex", F.when(k != 2, F.col("stump_hex")))
    want = F.when(k == 3, S.sha256_hex(F.col("block_hash"))).otherwise(F.col("block_hash"))
    return D.valid_stumps(e, F.col("height") + F.when(k == 1, 1).otherwise(0), want).select("block_hash", "subtree_index", "ok")


@query
def receiver_totals(spark, sf):
    """Proofs and finished blocks as each receiver counts them, with nothing else among them."""
    size = F.octet_length("url").cast("long").alias("bytes")
    got = stump_callbacks(spark, sf).select("url", F.lit("STUMP").alias("type"), size)
    got = got.unionByName(block_processed_broadcast(spark, sf).select("url", F.lit("BLOCK_PROCESSED").alias("type"), size))
    return D.totals_by_type(got)


@query
def exactly_one_block_processed(spark, sf):
    return D.exactly_one(block_processed_broadcast(spark, sf), "block_hash", "url")


@query
def bulk_register_summary(spark, sf):
    return watch_validation(spark, sf).groupBy((F.col("status") == 200).alias("ok")).agg(F.count("*").alias("n"))


@query
def registry_keys(spark, sf):
    u = T.url_sightings(spark, sf).select("url").distinct()
    return u.select("url", S.registry_key("url").alias("key"), S.stump_key(F.concat(F.lit("stump/"), "url")).alias("trimmed"))


@query
def appended_values(spark, sf):
    """Subtree ids appended by user in the order they came."""
    return D.appended(T.observations(spark, sf), "txid", "subtree_id", "ts", "seq").select("txid", F.sha2("subtree_id", 256).alias("digest"))


@query
def tracked_txids(spark, sf):
    e = T.url_sightings(spark, sf).select(F.col("token").alias("txid"), F.col("url").alias("urls"), F.col("last_seen").alias("ts"))
    return R.tracked(e)


@query
def running_dedup_hits(spark, sf):
    """How many sightings of each subtree a dedup by subtree suppresses."""
    o = T.observations(spark, sf)
    return o.groupBy("subtree_id").agg((F.count("*") - 1).alias("suppressed"))


@query
def dead_letters_also_count_down(spark, sf):
    """Work that ran out of attempts is finished too: remaining after successes, and after dead letters as well."""
    expected, finished = work(spark, sf)
    everything = T.leaves(spark, sf).select("block_hash", "subtree_index").distinct()
    lost = everything.join(finished.select("block_hash", "subtree_index"), ["block_hash", "subtree_index"], "left_anti")
    both = B.countdown(expected, finished.select("block_hash", "subtree_index").unionByName(lost)).select("block_hash", F.col("remaining").alias("after_dlq"))
    return B.countdown(expected, finished).select("block_hash", "remaining").join(both, "block_hash")
