"""The sighting path: grouping by callback, chunks, distinct sightings, and the threshold that fires once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 5_000
THRESHOLD = 3


def first_token(order: str) -> Column:
    """The first token, by order, that is not empty; null if none is."""
    some = F.col("token") != ""
    return F.min_by(F.when(some, F.col("token")), F.when(some, F.col(order)))


def by_url(found: DataFrame, *scope: str, order: str = "leaf_index") -> DataFrame:
    """scope columns, url, token (first_token by order), n, txids."""
    return found.groupBy(*scope, "url").agg(first_token(order).alias("token"), F.count("*").alias("n"), F.sort_array(F.collect_list("txid")).alias("txids"))


def chunked(found: DataFrame, size: int = CHUNK, *scope: str, order: str = "leaf_index") -> DataFrame:
    """scope columns, url, chunk, token, txids: sorted txids in runs of at most size, so no message or row grows without
    bound. All chunks of a url carry one token: the first by order that is not empty (none if found has no token)."""
    n = F.row_number().over(Window.partitionBy(*scope, "url").orderBy("txid")) - 1
    token = F.lit(None).cast("string")
    if "token" in found.columns:
        some = F.struct(F.col(order).alias("at"), F.col("token").alias("token"))
        token = F.min(F.when(F.col("token") != "", some)).over(Window.partitionBy(*scope, "url"))["token"]
    found = found.withColumn("chunk", F.floor(n / size)).withColumn("token", token)
    return found.groupBy(*scope, "url", "chunk").agg(F.first("token").alias("token"), F.sort_array(F.collect_list("txid")).alias("txids"))


def messages(found: DataFrame, kind: str, chunk: int = CHUNK, order: str = "leaf_index") -> DataFrame:
    """Seen-messages of found (subtree, txid, url, token), in chunks: callbackUrl, callbackToken, type, subtreeHash, txids."""
    c = chunked(found, chunk, "subtree", order=order)
    return c.select(F.col("url").alias("callbackUrl"), F.coalesce("token", F.lit("")).alias("callbackToken"), F.lit(kind).alias("type"), F.col("subtree").alias("subtreeHash"), "txids")


def first_sightings(observed: DataFrame) -> DataFrame:
    """txid, subtree_id, first_ts: one row for each distinct pair."""
    return observed.groupBy("txid", "subtree_id").agg(F.min("ts").alias("first_ts"))


def distinct_counts(observed: DataFrame) -> DataFrame:
    return observed.groupBy("txid").agg(F.count_distinct("subtree_id").alias("n"))


def approximate_counts(observed: DataFrame, error: float = 0.02) -> DataFrame:
    return observed.groupBy("txid").agg(F.approx_count_distinct("subtree_id", error).alias("n"))


def fired(observed: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """txid, subtree_id, fired_at: the sighting that first makes a txid's distinct count reach the threshold."""
    order = Window.partitionBy("txid").orderBy("first_ts", "subtree_id")
    ranked = first_sightings(observed).withColumn("n", F.row_number().over(order)).where(F.col("n") == threshold)
    return ranked.select("txid", "subtree_id", F.col("first_ts").alias("fired_at"))


def deduplicated(messages: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The first message of each key."""
    order = Window.partitionBy(key).orderBy(ts, "seq")
    return messages.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
