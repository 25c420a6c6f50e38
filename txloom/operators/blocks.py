"""The block path: fan-out, countdown, broadcast to all urls, accumulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fan_out(blocks: DataFrame) -> DataFrame:
    """One work row for each subtree of a block. blocks: block_hash, height, subtrees (ordered hashes)."""
    return blocks.select("block_hash", "height", F.posexplode("subtrees").alias("subtree_index", "subtree_hash"))


def countdown(expected: DataFrame, finished: DataFrame) -> DataFrame:
    """block_hash, expected, finished, remaining. finished: block_hash, subtree_index of work that succeeded or was
    given up; a block without an expectation counts as none remaining."""
    done = finished.select("block_hash", "subtree_index").distinct().groupBy("block_hash").agg(F.count("*").alias("finished"))
    joined = expected.select("block_hash", "expected").join(done, "block_hash", "full")
    return joined.select("block_hash", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("finished", F.lit(0)).alias("finished")).withColumn("remaining", F.greatest(F.lit(0), F.col("expected") - F.col("finished")))


def running_remaining(expected: DataFrame, finished: DataFrame) -> DataFrame:
    """block_hash, subtree_index, remaining after each finish, in the order of finished_at."""
    order = Window.partitionBy("block_hash").orderBy("finished_at", "subtree_index").rowsBetween(Window.unboundedPreceding, 0)
    return finished.join(expected, "block_hash").select("block_hash", "subtree_index", (F.col("expected") - F.count("*").over(order)).alias("remaining"))


def broadcast_done(done: DataFrame, urls: DataFrame) -> DataFrame:
    """One BLOCK_PROCESSED for each (finished block, active url). Every pair is a message, so the product is the result."""
    return done.select("block_hash").crossJoin(urls.select("url", "token"))


def accumulated(found: DataFrame) -> DataFrame:
    """block_hash, url, entries (subtree_index, txids): what one flush of a block hands over."""
    each = found.groupBy("block_hash", "url", "subtree_index").agg(F.sort_array(F.collect_list("txid")).alias("txids"))
    return each.groupBy("block_hash", "url").agg(F.array_sort(F.collect_list(F.struct("subtree_index", "txids"))).alias("entries"))


def pruned(blobs: DataFrame, height: int) -> DataFrame:
    """Blobs that stay when the chain reaches height: those without a delete height or with a later one."""
    return blobs.where(F.col("delete_at_height").isNull() | (F.col("delete_at_height") > height))
