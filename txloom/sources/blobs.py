"""A blob store as an append-only table: writes and deletes are rows, the latest row of a key counts.

Each write adds one folder (`write=<n>`), named by its caller's batch, and replaces what an earlier try left there, so a
replay changes nothing. Blobs may carry the chain height from which they are pruned. `compacted` rewrites the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.sources.readers import safe_key

SCHEMA = "key string, data binary, delete_at_height long, deleted boolean, write long"
#: Heights that a stored subtree outlives its block by.
KEEP = 10


def _write(rows: DataFrame, path: str, write: int) -> None:
    key = F.when(safe_key("key"), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("unsafe blob key: "), F.coalesce("key", F.lit("null")))))
    rows.select(key.alias("key"), "data", "delete_at_height", "deleted").write.mode("overwrite").parquet(f"{path}/write={write}")


def put(blobs: DataFrame, path: str, write: int, height: str | None = None, keep: int = KEEP) -> None:
    """Store blobs (key, data); with `height`, a column of block heights, each is to go `keep` heights later (0 and null: never)."""
    at = F.when(F.col(height) > 0, F.col(height) + keep).cast("long") if height else F.lit(None).cast("long")
    _write(blobs.withColumn("delete_at_height", at).withColumn("deleted", F.lit(False)), path, write)


def delete(keys: DataFrame, path: str, write: int) -> None:
    """Delete keys (key); those that the store does not have are no error."""
    _write(keys.select("key", F.lit(None).cast("binary").alias("data"), F.lit(None).cast("long").alias("delete_at_height"), F.lit(True).alias("deleted")), path, write)


def latest(spark: SparkSession, path: str, height: int | None = None) -> DataFrame:
    """key, data, delete_at_height of the blobs that stand; with the chain's height, without those that are due."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(path)
    except Exception as e:  # nothing was written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], SCHEMA)
    last = rows.groupBy("key").agg(F.max_by(F.struct("data", "delete_at_height", "deleted"), "write").alias("b")).where("not b.deleted")
    out = last.select("key", "b.data", "b.delete_at_height")
    return out if height is None else out.where(F.col("delete_at_height").isNull() | (F.col("delete_at_height") > height))


def compacted(spark: SparkSession, path: str, target: str, height: int | None = None) -> None:
    """Write what stands to a new table."""
    latest(spark, path, height).withColumn("deleted", F.lit(False)).write.mode("overwrite").parquet(f"{target}/write=0")


def with_remote(spark: SparkSession, wanted: DataFrame, path: str, write: int, **options) -> DataFrame:
    """subtree_hash, data of wanted (base, subtree_hash): from the store, else from the hub; what had to be fetched is stored."""
    from txloom.sources import hub

    have = latest(spark, path).select(F.col("key").alias("subtree_hash"), "data")
    missing = wanted.join(have.select("subtree_hash"), "subtree_hash", "left_anti").dropDuplicates(["subtree_hash"])
    put(hub.fetched(missing, **options).where("data is not null").select(F.col("subtree_hash").alias("key"), "data"), path, write)
    return wanted.select("subtree_hash").distinct().join(latest(spark, path).select(F.col("key").alias("subtree_hash"), "data"), "subtree_hash")
