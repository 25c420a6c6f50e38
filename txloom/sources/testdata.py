"""The domain laid over the supplied tables: transactions, blocks, subtree leaves, registrations, sightings, deliveries.

Each view is a DataFrame over parquet, so filters and column choices reach the scan. Hashes are lowercase hex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txloom.functions.scalars import reversed_hex, sha256_hex

SUBTREE_SIZE = 64
#: Keys of a range in which transactions are numbered.
KEY_RANGE = 1 << 16
FIRST_HEIGHT = 800_000
NOW = "2024-02-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_hash(order_key) -> F.Column:
    return sha256_hex(F.concat(F.lit("tx:"), order_key.cast("string")))


def transactions(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """tx_key, month, raw_hex (internal byte order), txid (display order), extra columns of orders: one row an order."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_key"), F.trunc("o_orderdate", "MM").alias("month"), *extra)
    return o.withColumn("raw_hex", raw_hash(F.col("tx_key"))).withColumn("txid", reversed_hex("raw_hex", 32))


def leaves(spark: SparkSession, sf_dir: str, size: int = SUBTREE_SIZE, *extra: str) -> DataFrame:
    """height, block_hash, subtree_index, leaf_index, raw_hex, txid: ordered leaves of each block's subtrees, one block a
    month. Transactions are numbered within ranges of keys, and ranges by the sums of those before, so no task holds a
    whole block."""
    tx = transactions(spark, sf_dir, *extra).withColumn("range", F.expr(f"tx_key div {KEY_RANGE}"))
    sizes = tx.groupBy("month", "range").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("month").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    # only the distinct months are ranked in one task; ranges are counted within their month
    height = F.lit(FIRST_HEIGHT).cast("long") + F.row_number().over(Window.orderBy("month")) - 1
    months = tx.select("month").distinct().withColumn("height", height)
    begins = sizes.withColumn("begin", F.coalesce(before, F.lit(0))).join(months, "month")
    begins = begins.withColumn("block_hash", sha256_hex(F.concat(F.lit("block:"), F.col("height").cast("string")))).drop("size")
    place = F.row_number().over(Window.partitionBy("month", "range").orderBy("tx_key")) - 1
    tx = tx.withColumn("place", place).join(begins, ["month", "range"]).withColumn("n", F.col("begin") + F.col("place"))
    return tx.select("height", "block_hash", F.expr(f"n div {size}").alias("subtree_index"), F.expr(f"n % {size}").alias("leaf_index"), "raw_hex", "txid", *extra)


def registration_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_hex, txid, url, token, seq: requests in a total order (seq), from returned line items."""
    li = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").withColumn("raw_hex", raw_hash(F.col("l_orderkey")))
    seq = F.struct("l_shipdate", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    token = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("tok-"), F.col("l_linenumber").cast("string")))
    return li.select("raw_hex", reversed_hex("raw_hex", 32).alias("txid"), url_of(F.col("l_suppkey")).alias("url"), token.alias("token"), seq.alias("seq"))


def url_of(key) -> F.Column:
    return F.concat(F.lit("https://subscriber-"), (key % 20).cast("string"), F.lit(".example/callback"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txid (the user), subtree_id, ts, seq: sightings, with natural repeats."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("txid"), F.concat_ws("-", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("subtree_id"), "ts", F.col("event_id").alias("seq"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, url, seq, ts, ok: delivery attempts of one message a user; errors fail."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), url_of(F.col("user_id")).alias("url"), F.col("event_id").alias("seq"), "ts", (F.col("event_type") != "error").alias("ok"), "event_type")


def url_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, token, last_seen, seq."""
    e = read(spark, sf_dir, "events")
    return e.select(url_of(F.col("user_id")).alias("url"), F.concat(F.lit("tok-"), (F.col("event_id") % 7).cast("string")).alias("token"), F.col("ts").alias("last_seen"), F.col("event_id").alias("seq"))
