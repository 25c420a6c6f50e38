"""Readers and sinks for the forms that announcements, blobs and registrations come in."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txloom.functions.scalars import TXID, hex_of, reversed_hex, sha256_hex

_f = T.StructField
SUBTREE_MESSAGE = T.StructType([_f("hash", T.StringType()), _f("dataHubUrl", T.StringType()), _f("peerId", T.StringType()), _f("clientName", T.StringType()), _f("attemptCount", T.IntegerType())])
BLOCK_MESSAGE = T.StructType([_f("hash", T.StringType()), _f("height", T.LongType()), _f("header", T.StringType()), _f("coinbase", T.StringType()), _f("dataHubUrl", T.StringType()), _f("peerId", T.StringType()), _f("clientName", T.StringType())])
SUBTREE_WORK = T.StructType([_f("blockHash", T.StringType()), _f("blockHeight", T.LongType()), _f("subtreeHash", T.StringType()), _f("subtreeIndex", T.IntegerType()), _f("dataHubUrl", T.StringType()), _f("attemptCount", T.IntegerType())])
CALLBACK_MESSAGE = T.StructType([_f("callbackUrl", T.StringType()), _f("callbackToken", T.StringType()), _f("type", T.StringType()), _f("txid", T.StringType()), _f("txids", T.ArrayType(T.StringType())), _f("blockHash", T.StringType()), _f("subtreeHash", T.StringType()), _f("subtreeIndex", T.IntegerType()), _f("stumpRef", T.StringType()), _f("retryCount", T.IntegerType()), _f("nextRetryAt", T.TimestampType())])
WATCH_REQUEST = T.StructType([_f("txid", T.StringType()), _f("callbackUrl", T.StringType()), _f("callbackToken", T.StringType())])
BLOCK_META = T.StructType([_f("height", T.LongType()), _f("subtrees", T.ArrayType(T.StringType())), _f("transaction_count", T.LongType())])
MANIFEST = T.StructType([_f("seed", T.LongType()), _f("blockHash", T.StringType()), _f("blockHeight", T.LongType()), _f("totalTxids", T.IntegerType()), _f("subtrees", T.ArrayType(T.StructType([_f("index", T.IntegerType()), _f("hash", T.StringType()), _f("txidIndices", T.ArrayType(T.IntegerType()))])))])


def decoded(df: DataFrame, schema: T.StructType, key: str, value: str = "value", strict: bool = False) -> DataFrame:
    """The messages of a JSON column; rows that do not decode or lack their key are dropped (strict: they fail the job)."""
    parsed = F.from_json(F.col(value).cast("string"), schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    out = df.withColumn("_m", parsed).select("_m.*")
    return out if strict else out.where(F.coalesce(F.col(key), F.lit("")) != "")


def encoded(*fields: Column) -> Column:
    """JSON text; zero numbers and empty strings that a caller turned to null are left out."""
    return F.to_json(F.struct(*fields))


#: Fields that the JSON of a message leaves out when they are empty or zero; all others are always written.
LEFT_OUT = {"attemptCount", "callbackToken", "txid", "txids", "blockHash", "subtreeHash", "subtreeIndex", "stumpRef", "retryCount", "nextRetryAt"}
ALWAYS = {"SUBTREE_WORK": {"blockHash", "subtreeHash", "subtreeIndex"}}


def message_json(schema: T.StructType, always: set[str] = frozenset()) -> Column:
    """The JSON of one message from columns named as its fields; columns that are null count as empty."""
    fields = []
    for f in schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            empty, some = F.array().cast(f.dataType), F.size(c) > 0
        elif isinstance(f.dataType, T.TimestampType):
            empty, some = F.lit(None).cast("timestamp"), c.isNotNull()
        else:
            empty = F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType)
            some = c != empty
        fields.append((F.when(some, c) if f.name in LEFT_OUT and f.name not in always else F.coalesce(c, empty)).alias(f.name))
    return F.to_json(F.struct(*fields))


def subtree_messages(announced: DataFrame) -> DataFrame:
    """key, value: announcements of subtrees (hash, dataHubUrl, peerId, clientName) as messages of their topic."""
    return announced.withColumn("attemptCount", F.lit(0)).select(F.col("hash").alias("key"), message_json(SUBTREE_MESSAGE).alias("value"))


def block_messages(announced: DataFrame) -> DataFrame:
    """key, value: announcements of blocks (hash, height, header, coinbase, dataHubUrl, peerId, clientName)."""
    return announced.select(F.col("hash").alias("key"), message_json(BLOCK_MESSAGE).alias("value"))


def whole_callbacks(df: DataFrame) -> DataFrame:
    """df with every field of CALLBACK_MESSAGE, null where it has none; other columns go."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CALLBACK_MESSAGE])


def callback_messages(df: DataFrame) -> DataFrame:
    """value: callbacks (columns of CALLBACK_MESSAGE) as messages."""
    return df.select(message_json(CALLBACK_MESSAGE).alias("value"))


def work_messages(df: DataFrame) -> DataFrame:
    """key, value: subtree work (columns of SUBTREE_WORK), keyed by block."""
    return df.select(F.col("blockHash").alias("key"), message_json(SUBTREE_WORK, ALWAYS["SUBTREE_WORK"]).alias("value"))


def parse_block(data: bytes) -> dict:
    """A block in its binary form: header of 80 bytes, counts, subtree hashes, coinbase transaction, height. Hashes are
    shown last byte first. ValueError if it is malformed."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("the block ends early")
        at += n
        return data[at - n : at]

    def number(size: int = 0) -> int:
        if size:
            return int.from_bytes(take(size), "little")
        first = take(1)[0]
        return first if first < 0xFD else number({0xFD: 2, 0xFE: 4, 0xFF: 8}[first])

    shown = lambda: take(32)[::-1].hex()
    out = {"version": number(4), "hash_prev_block": shown(), "hash_merkle_root": shown(), "timestamp": number(4), "bits": take(4)[::-1].hex(), "nonce": number(4)}
    out |= {"transaction_count": number(), "size_in_bytes": number()}
    count = number()
    if count * 32 > len(data):
        raise ValueError("the block ends early")
    out["subtrees"] = [shown() for _ in range(count)]
    take(4)  # the coinbase: version, inputs, outputs, lock time
    for _ in range(number()):
        take(36)
        take(number())
        take(4)
    for _ in range(number()):
        take(8)
        take(number())
    take(4)
    out["height"] = number()
    return out


def parsed_blocks(blobs: DataFrame, key: str = "block_hash", data: str = "data") -> DataFrame:
    """key, height, version, hash_prev_block, hash_merkle_root, timestamp, bits, nonce, subtrees, transaction_count, error of
    binary blocks; one that is malformed, or null, has an error and nothing else."""
    names = [("height", pa.int64()), ("version", pa.int64()), ("hash_prev_block", pa.string()), ("hash_merkle_root", pa.string()), ("timestamp", pa.int64()), ("bits", pa.string()), ("nonce", pa.int64()), ("subtrees", pa.list_(pa.string())), ("transaction_count", pa.int64())]
    had = "error" in blobs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for b, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    if b is None:
                        raise ValueError(e or "no data")
                    made.append(parse_block(b) | {"error": e})
                except ValueError as problem:
                    made.append({"error": str(problem)})
            cols = [pa.array([m.get(n) for m in made], t) for n, t in [*names, ("error", pa.string())]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["key", *[n for n, _ in names], "error"])

    kinds = "key string, height long, version long, hash_prev_block string, hash_merkle_root string, timestamp long, bits string, nonce long, subtrees array<string>, transaction_count long, error string"
    rows = blobs.select(F.col(key).cast("string").alias("key"), F.col(data).alias("data"), (F.col("error") if had else F.lit(None).cast("string")).alias("error"))
    return rows.mapInArrow(run, kinds).withColumnRenamed("key", key)


def messages(spark: SparkSession, path: str, schema: T.StructType, streaming: bool = False, fmt: str = "parquet", **options: str) -> DataFrame:
    """A message log: a parquet directory, or a topic if the session has that connector (read from the earliest offset)."""
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        return reader.format("kafka").option("subscribe", path).option("startingOffsets", "earliest").options(**options).load()
    return reader.schema(schema).options(**options).format(fmt).load(path)


def txid_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid txids, bad lines) of text files: one txid a line, blank lines and # comments skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("txid")).where("txid <> '' and not startswith(txid, '#')")
    return lines.where(F.col("txid").rlike(TXID)), lines.where(~F.col("txid").rlike(TXID))


def blobs(spark: SparkSession, path: str, limit: int = 1 << 30) -> DataFrame:
    """name, data of binary files no larger than limit."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= limit)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("data"))


def safe_key(key: Column | str) -> Column:
    """False for keys that could leave their folder."""
    k = F.col(key) if isinstance(key, str) else key
    return ~((k == "") | k.startswith("/") | k.contains("\\") | k.rlike(r"(^|/)\.\.(/|$)"))


def split_hashes(df: DataFrame, data: str = "data", size: int = 32) -> DataFrame:
    """leaf_index, raw_hex, txid for each 32-byte hash of a binary column; raises if its length is no multiple."""
    n = F.octet_length(data)
    good = F.when(n % size == 0, n / size).otherwise(F.raise_error(F.lit("subtree data is no whole number of hashes"))).cast("int")
    h = hex_of(data)
    cut = F.transform(F.sequence(F.lit(0), good - 1), lambda i: F.substring(h, i * (2 * size) + 1, F.lit(2 * size)))
    rows = df.where(n > 0).select(*[c for c in df.columns if c != data], F.posexplode(cut).alias("leaf_index", "raw_hex"))
    return rows.withColumn("txid", reversed_hex("raw_hex"))


def fixture_txids(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """i, raw_hex: SHA-256 over seed and i, each an unsigned big-endian 64-bit number."""
    be = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return spark.range(n).select(F.col("id").alias("i"), F.sha2(F.unhex(F.concat(be(F.lit(seed).cast("long")), be(F.col("id")))), 256).alias("raw_hex"))


def round_robin(txids: DataFrame, subtrees: int) -> DataFrame:
    """txids with the subtree that each is dealt to."""
    return txids.withColumn("subtree_index", F.col("i") % subtrees).withColumn("leaf_index", F.expr(f"i div {subtrees}"))


def content_address(data: Column | str) -> Column:
    return sha256_hex(data)
