"""A Bloom sketch of keys, built by partial aggregates and tested before a shuffle.

The sketch is a table of 64-bit words (word, bits): each key sets `HASHES` bits, equal words are joined by a bitwise or, so
parts made from parts of the keys add up to the sketch of all, in any order. It is sized from the count of keys; a test needs
it whole, as one value, so beyond `MOST_WORDS` there is none, and callers go without. A key that was put in always passes;
of others about one in a hundred does, which costs bytes and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY, HASHES = 12, 3
LEAST_WORDS, MOST_WORDS = 1 << 6, 1 << 20
SCHEMA = "word long, bits long"


def words_for(keys: int) -> int | None:
    """How many words a sketch of so many keys has (a power of two), or None if that is beyond MOST_WORDS."""
    words = LEAST_WORDS
    while words * 64 < keys * BITS_A_KEY:
        words *= 2
    return words if words <= MOST_WORDS else None


def _places(key: Column, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(words * 64).cast("long")) for i in range(HASHES)]


def sketch(keys: DataFrame, key: str, words: int) -> DataFrame:
    """word, bits: the words that any key sets."""
    bit = F.struct(F.shiftright("p", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int")).alias("bits"))
    rows = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), words))).alias("p")).select(bit.alias("b")).select("b.*")
    return joined(rows)


def joined(parts: DataFrame) -> DataFrame:
    """Sketches of as many words, as one."""
    return parts.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def whole(parts: DataFrame, words: int) -> DataFrame:
    """The sketch as one row with an array of all its words."""
    every = parts.sparkSession.range(words).select(F.col("id").alias("word"))
    rows = every.join(joined(parts), "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    return rows.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("bits"))


def may_hold(key: Column, parts: DataFrame, words: int) -> Column:
    """False only for keys that the sketch was not made of. The sketch is a subquery, computed once for all rows."""
    bits = whole(parts, words).scalar()
    hit = lambda p: F.element_at(bits, (F.shiftright(p, 6) + 1).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) != 0
    one, *more = [hit(p) for p in _places(key, words)]
    for other in more:
        one = one & other
    return one
