"""Registrations and callback urls: validation, upsert, cap, lookup, time-to-live, sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txloom.functions.scalars import TOKEN_LIMIT, TXID, let, url_error


def requests_of(bodies: DataFrame, body: str = "body") -> DataFrame:
    """bodies with txid, callbackUrl, callbackToken and undecodable: whether the body is no JSON object of texts (null fields,
    missing ones and a null body count as empty)."""
    v = F.try_parse_json(F.coalesce(F.col(body), F.lit("")))
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    names = ("txid", "callbackUrl", "callbackToken")
    is_object = kind(v).startswith("OBJECT")
    texts = [kind(F.when(is_object, F.try_variant_get(v, f"$.{n}", "variant"))).isin("STRING", "VOID") for n in names]
    good = v.isNotNull() & (is_object | (kind(v) == "VOID")) & texts[0] & texts[1] & texts[2]
    fields = [F.when(good & is_object, F.try_variant_get(v, f"$.{n}", "string")).alias(n) for n in names]
    return bodies.select("*", *fields, (~F.coalesce(good, F.lit(False))).alias("undecodable"))


def validate_watch(requests: DataFrame, allow_private: bool = False) -> DataFrame:
    """requests (txid, callbackUrl, callbackToken) with status and error: the first check that fails decides. A column
    undecodable (requests_of) marks bodies that could not be read."""
    broken = F.col("undecodable") if "undecodable" in requests.columns else F.lit(False)
    # The answers that clients see.
    checks = lambda why: [
        (broken, "invalid request body"),
        (F.coalesce(F.col("txid"), F.lit("")) == "", "txid is required"),
        (~F.col("txid").rlike(TXID), "invalid txid format: must be a 64-character hex string"),
        (F.coalesce(F.col("callbackUrl"), F.lit("")) == "", "callbackUrl is required"),
        (F.coalesce(why, F.lit("")).startswith("blocked"), "invalid callbackUrl: host is on the SSRF deny-list (private, loopback, link-local, or metadata-endpoint address)"),
        (why.isNotNull(), "invalid callbackUrl: must be a valid HTTP/HTTPS URL with a public host"),
        (F.octet_length(F.coalesce("callbackToken", F.lit(""))) > TOKEN_LIMIT, "invalid callbackToken: exceeds maximum length"),
    ]
    error = let(url_error("callbackUrl", allow_private), lambda why: F.coalesce(*[F.when(c, F.lit(m)) for c, m in checks(why)]))
    return requests.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), 200).otherwise(400))


def answered_lookup(asked: DataFrame, registrations: DataFrame) -> DataFrame:
    """asked (txid and other columns) with status, error and urls, in order: who is registered, without any token."""
    bad = ~F.coalesce(F.col("txid").rlike(TXID), F.lit(False))
    urls = registrations.groupBy("txid").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    out = asked.join(urls, "txid", "left")
    # Fixed value: the answer that clients see.
    error = F.when(bad, "invalid txid format: must be a 64-character hex string")
    return out.select(*asked.columns, F.when(bad, 400).otherwise(200).alias("status"), error.alias("error"), F.when(~bad, F.coalesce("urls", F.array().cast("array<string>"))).alias("urls"))


#: Fixed value: the answer to a request over the cap.
OVER_CAP = "too many callback URLs registered for this txid"


def admitted(checked: DataFrame, known: DataFrame, cap: int) -> DataFrame:
    """Checked requests (validate_watch, with seq: their order) against the urls that txids have already (known: txid, url):
    a pair beyond the first `cap` of its txid is answered with 429; a pair that is known, or repeats, is refreshed."""
    pair = [F.col("txid"), F.col("callbackUrl").alias("url")]
    asked = checked.where("status = 200").groupBy(*pair).agg(F.min(F.struct(F.lit(1).alias("new"), F.col("seq").alias("seq"))).alias("at"))
    had = known.select("txid", "url").distinct().withColumn("at", F.struct(F.lit(0).alias("new"), F.lit(None).cast(checked.schema["seq"].dataType).alias("seq")))
    both = asked.unionByName(had).groupBy("txid", "url").agg(F.min("at").alias("at"))
    slot = F.row_number().over(Window.partitionBy("txid").orderBy("at", "url"))
    late = both.withColumn("slot", slot).where(F.col("slot") > cap).where("at.new = 1").select("txid", F.col("url").alias("callbackUrl"), F.lit(True).alias("_late"))
    out = checked.join(late, ["txid", "callbackUrl"], "left")
    over = F.col("_late") & (F.col("status") == 200)
    return out.withColumn("error", F.when(over, OVER_CAP).otherwise(F.col("error"))).withColumn("status", F.when(over, 429).otherwise(F.col("status"))).drop("_late")


def resolved_ok(urls: DataFrame, resolution: DataFrame, allow_private: bool = False) -> DataFrame:
    """urls (url, host) that a resolution table (host, address) leads to public addresses only; unresolved hosts go."""
    from txloom.functions.scalars import blocked_ip

    checked = resolution.withColumn("bad", blocked_ip(F.col("address"), allow_private)).groupBy("host").agg(F.max("bad").alias("bad"))
    return urls.join(checked.where(~F.col("bad")), "host", "left_semi")


def latest_registrations(events: DataFrame, key: str = "txid") -> DataFrame:
    """txid, url, token (of the latest event), first_seq: one row for each pair. events: txid (or key), url, token, seq."""
    return events.groupBy(key, "url").agg(F.max_by("token", "seq").alias("token"), F.min("seq").alias("first_seq"))


def capped(registrations: DataFrame, cap: int, key: str = "txid") -> DataFrame:
    """The first `cap` distinct urls of each txid; known urls are refreshed whatever the cap."""
    order = Window.partitionBy(key).orderBy("first_seq", "url")
    return registrations.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= cap)


def over_cap(registrations: DataFrame, cap: int) -> DataFrame:
    """Pairs that the cap refuses (status 429)."""
    order = Window.partitionBy("txid").orderBy("first_seq", "url")
    return registrations.withColumn("slot", F.row_number().over(order)).where(F.col("slot") > cap)


def lookup(leaves: DataFrame, registrations: DataFrame, key: str = "txid") -> DataFrame:
    """leaves joined to who registered for them. Exact text match; expired rows match until they are swept.

    Of a txid that a subtree repeats only the last leaf counts; only the leaves that matched are aggregated. Spark picks
    the strategy of the join: a small registry is broadcast, a large one is shuffled on the key with skewed keys split.
    """
    scope = ["height", "block_hash", "subtree_index"]
    hit = leaves.select(*scope, key, "leaf_index").join(registrations.select(key, "url", "token"), key)
    return hit.groupBy(*scope, key, "url", "token").agg(F.max("leaf_index").alias("leaf_index"))


def nested(registrations: DataFrame) -> DataFrame:
    """txid, callbacks: the set-valued form."""
    return registrations.groupBy("txid").agg(F.array_sort(F.collect_set(F.struct("url", "token"))).alias("callbacks"))


def entry(text: Column) -> Column:
    """A stored entry of either shape: a {u, t} object or a bare url; null if it has no url."""
    parsed = F.from_json(text, "u string, t string")
    made = F.when(text.startswith("{"), F.struct(parsed["u"].alias("url"), F.coalesce(parsed["t"], F.lit("")).alias("token"))).otherwise(F.struct(text.alias("url"), F.lit("").alias("token")))
    return F.when(F.coalesce(made["url"], F.lit("")) != "", made)


def with_ttl(registrations: DataFrame, txids: DataFrame, now: str, seconds: int) -> DataFrame:
    """registrations (txid, expires_at) with the expiry of the txids given set to now + seconds."""
    hit = txids.select("txid").distinct().withColumn("_hit", F.lit(True))
    new = F.lit(now).cast("timestamp_ntz") + F.make_interval(secs=F.lit(seconds))
    return registrations.join(hit, "txid", "left").withColumn("expires_at", F.when(F.col("_hit"), new).otherwise(F.col("expires_at"))).drop("_hit")


def swept(parents: DataFrame, children: DataFrame, now: str, key: str = "txid") -> tuple[DataFrame, DataFrame]:
    """Parents that have not expired (null never does; equality has not yet) and their children."""
    kept = parents.where(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now).cast("timestamp_ntz")))
    return kept, children.join(kept.select(key), key, "left_semi")


def url_registry(sightings: DataFrame) -> DataFrame:
    """url, last_seen, token: one row a url, the latest sighting's. sightings: url, token, last_seen, seq."""
    return sightings.groupBy("url").agg(F.max("last_seen").alias("last_seen"), F.max_by("token", "seq").alias("token"))


def active_urls(registry: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Urls seen within the last days, or with no time on record."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))
    return registry.where(F.col("last_seen").isNull() | (F.col("last_seen") >= cutoff))


def tracked(events: DataFrame) -> DataFrame:
    """txid, urls (of the last registration), first_at: insert or replace, with the first time kept. events: txid, urls, ts."""
    return events.groupBy("txid").agg(F.max_by("urls", "ts").alias("urls"), F.min("ts").alias("first_at"))
