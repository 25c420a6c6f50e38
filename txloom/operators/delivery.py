"""Delivery: what was delivered before, retries, dead letters, order, payloads, reports."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType, StructField, StructType

from txloom.functions.scalars import linear_backoff

MAX_RETRIES = 5
BACKOFF_SECONDS = 30


def undelivered(messages: DataFrame, delivered: DataFrame, now: str) -> DataFrame:
    """Messages whose dedup_key has no record that is still valid (at equality it is not); a null key is never a duplicate."""
    valid = delivered.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp_ntz")))
    return messages.join(valid.select("dedup_key"), "dedup_key", "left_anti")


def recorded(records: DataFrame) -> DataFrame:
    """dedup_key, expires_at: a later record overwrites an earlier one, null included."""
    return records.groupBy("dedup_key").agg(F.max_by(F.struct("expires_at"), "seq").alias("_e")).select("dedup_key", F.col("_e.expires_at").alias("expires_at"))


def callback_state(ok: Column, permanent: Column, retry: Column, limit: int = MAX_RETRIES) -> Column:
    return F.when(ok, "delivered").when(permanent, "dlq").when(retry >= limit, "dlq").otherwise("retry")


def work_state(ok: Column, attempt: Column, limit: int) -> Column:
    """For subtree and block work the attempt to come decides: one fewer than for callbacks."""
    return F.when(ok, "done").when(attempt + 1 >= limit, "dlq").otherwise("retry")


def scheduled(attempts: DataFrame, limit: int = MAX_RETRIES, base: int = BACKOFF_SECONDS) -> DataFrame:
    """attempts (key, url, seq, ts, ok) of each message in turn, up to the one that ends it, with retry count, state and
    the time of the next try."""
    before = Window.partitionBy("key").orderBy("ts", "seq")
    past = before.rowsBetween(Window.unboundedPreceding, -1)
    a = attempts.withColumn("retry", (F.row_number().over(before) - 1).cast("int"))
    a = a.withColumn("over", F.coalesce(F.max(F.col("ok").cast("int")).over(past), F.lit(0)))
    a = a.where((F.col("over") == 0) & (F.col("retry") <= limit)).drop("over")
    a = a.withColumn("state", callback_state(F.col("ok"), F.lit(False), F.col("retry"), limit))
    return a.withColumn("next_at", F.when(F.col("state") == "retry", linear_backoff("ts", base, F.col("retry") + 1)))


def outcomes(schedule: DataFrame) -> DataFrame:
    """key, tries, state of each message's last attempt."""
    return schedule.groupBy("key").agg(F.count("*").alias("tries"), F.max_by("state", "retry").alias("state"))


def due(messages: DataFrame, now: str, wait: int = 2) -> tuple[DataFrame, DataFrame]:
    """(due within `wait` seconds or not dated, the rest, to be queued again unchanged)."""
    limit = F.lit(now).cast("timestamp_ntz") + F.make_interval(secs=F.lit(wait))
    ready = F.col("next_at").isNull() | (F.col("next_at") <= limit)
    return messages.where(ready), messages.where(~ready)


def with_stump(messages: DataFrame, stumps: DataFrame) -> DataFrame:
    """messages with the proof's bytes; a missing proof is a permanent failure."""
    out = messages.join(stumps.select("stump_ref", "stump_hex"), "stump_ref", "left")
    return out.withColumn("permanent", F.col("stump_ref").isNotNull() & F.col("stump_hex").isNull())


def payload(kind: Column, txid: Column, txids: Column, block: Column, index: Column, stump: Column) -> Column:
    """The JSON body; what is empty or zero is left out."""
    some = lambda c: F.when(c != "", c)
    return F.to_json(F.struct(kind.alias("type"), some(txid).alias("txid"), F.when(F.size(txids) > 0, txids).alias("txids"), some(block).alias("blockHash"), F.nullif(index, F.lit(0)).alias("subtreeIndex"), some(stump).alias("stump")))


def in_order(messages: DataFrame, key: str = "partition_key", seq: str = "seq") -> DataFrame:
    """All messages of a key in one partition, in order."""
    return messages.repartition(key).sortWithinPartitions(key, seq)


#: Parts that a round of the selection cuts a range of values into.
PARTS = 4096


def percentiles(df: DataFrame, value: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles (n, least, most, p50, …) of a numeric column, exact, by distributed selection.

    Each round counts the values of a range in `PARTS` equal parts and goes on with the part that holds the rank, between
    its least and largest value, until those are equal: a scan a round with partial counts, two rounds for most data, and no
    task or driver that sees more than a row a part. Nulls and NaN do not count; an empty column gives n = 0 and nulls."""
    kind = df.schema[value].dataType
    v = F.col(value)
    if isinstance(kind, (FloatType, DoubleType)):
        exact, df = lambda c, by: c.cast("double") * by, df.where(~F.isnan(v))
    else:
        exact = lambda c, by: c.cast("decimal(38,10)")
    df = df.where(v.isNotNull()).select(v)
    n, least, most = df.agg(F.count("*"), F.min(v), F.max(v)).head()
    found: dict[float, object] = {}
    # (percentile, rank within the range, least and largest value of the range)
    open_ = [(p, max(1, math.ceil(Decimal(str(p)) * n)), least, most) for p in ps] if n else []
    while open_:
        found |= {p: lo for p, _, lo, hi in open_ if lo == hi}
        open_ = [x for x in open_ if x[2] != x[3]]
        if not open_:
            break

        def part(lo, hi) -> Column:
            by = 0.5 if math.isinf(float(hi) - float(lo)) else 1.0  # so that no difference overflows
            low, high = (exact(F.lit(x).cast(kind), by) for x in (lo, hi))
            share = (exact(v, by) - low).cast("double") / (high - low).cast("double")
            return F.least(F.lit(PARTS - 1), F.floor(share * PARTS).cast("int"))

        ranges = list(dict.fromkeys((lo, hi) for _, _, lo, hi in open_))
        each = F.array(*[F.when(v.between(F.lit(lo).cast(kind), F.lit(hi).cast(kind)), F.struct(F.lit(i).alias("i"), part(lo, hi).alias("part"))) for i, (lo, hi) in enumerate(ranges)])
        rows = df.select(v.alias("v"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("r")).groupBy("r.i", "r.part").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        after = []
        for p, rank, lo, hi in open_:
            for r in sorted((r for r in rows if r["i"] == ranges.index((lo, hi))), key=lambda r: r["part"]):
                if rank <= r["n"]:
                    after.append((p, rank, r["lo"], r["hi"]))
                    break
                rank -= r["n"]
        open_ = after
    schema = StructType([StructField("n", LongType()), *[StructField(c, kind) for c in ("least", "most", *[f"p{round(p * 100)}" for p in ps])]])
    return df.sparkSession.createDataFrame([(n, least, most, *[found.get(p) for p in ps])], schema)


def repeated(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def recent(df: DataFrame, n: int) -> DataFrame:
    """The n newest rows: a top-n, never a full sort."""
    return df.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def receiver_stats(df: DataFrame) -> DataFrame:
    """What each receiver got: counts by outcome, bytes, first and last time. df: url, ok, bytes, ts."""
    return df.groupBy("url").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.sum("bytes").alias("bytes"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def spurious(received: DataFrame, expected: DataFrame, *key: str) -> DataFrame:
    """Rows received but not expected, and expected but not received."""
    extra = received.select(*key).distinct().join(expected.select(*key), [*key], "left_anti").withColumn("what", F.lit("unexpected"))
    return extra.unionByName(expected.select(*key).distinct().join(received.select(*key), [*key], "left_anti").withColumn("what", F.lit("missing")))


def exactly_one(messages: DataFrame, *key: str) -> DataFrame:
    """key, n, ok: whether each key has exactly one message."""
    return messages.groupBy(*key).agg(F.count("*").alias("n")).withColumn("ok", F.col("n") == 1)


def totals_by_type(received: DataFrame, expected_blocks: Column | None = None) -> DataFrame:
    """url, n, stumps, block_processed, other, bytes, ok: what each receiver got by type (received: url, type, bytes). Nothing
    else than these two may come; expected_blocks: how many BLOCK_PROCESSED each receiver should have."""
    count = lambda t: F.count_if(F.col("type") == t)
    out = received.groupBy("url").agg(F.count("*").alias("n"), count("STUMP").alias("stumps"), count("BLOCK_PROCESSED").alias("block_processed"), F.sum("bytes").alias("bytes"))
    out = out.withColumn("other", F.col("n") - F.col("stumps") - F.col("block_processed"))
    ok = F.col("other") == 0
    return out.withColumn("ok", ok if expected_blocks is None else ok & (F.col("block_processed") == expected_blocks))


def valid_stumps(received: DataFrame, height: Column, block: Column | None = None) -> DataFrame:
    """received with ok: the proof is there, is hex, starts with the height that is expected, and (block: a hash to compare
    block_hash with) is of the block."""
    from txloom.functions.scalars import compact_size_hex

    hex_ = F.coalesce(F.col("stump_hex"), F.lit(""))
    ok = hex_.rlike("^([0-9a-f]{2})+$") & hex_.startswith(compact_size_hex(height))
    return received.withColumn("ok", ok if block is None else ok & F.coalesce(F.col("block_hash") == block, F.lit(False)))


def appended(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """key, value: all values of a key appended in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, value)))
    return df.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r[value]), "").alias(value))
