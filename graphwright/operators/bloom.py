"""Bloom filter built and probed by built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest filter: 2**22 words of 64 bits, 32 MiB, whatever the number of keys (22 million at BITS_PER_KEY; more keys share it and fewer absent ones are told).
MAX_WORDS = 1 << 22
#: Bits per key aimed at below that bound, and probes per key.
BITS_PER_KEY, PROBES = 12, 4
#: Words per segment of a filter: segments are put together apart, so no task holds more than one while it is built.
SEGMENT = 1 << 14


def _positions(key: list[Column], words: int) -> list[Column]:
    """Bit positions of a key by double hashing."""
    bits = F.lit(words * 64).cast("bigint")
    h1, h2 = F.pmod(F.xxhash64(*key), bits), F.pmod(F.xxhash64(*key, F.lit(0x9E37)), bits)
    return [F.pmod(h1 + F.lit(i).cast("bigint") * h2, bits) for i in range(PROBES)]


def words_for(keys: int) -> int:
    """Words (a power of two up to MAX_WORDS) for so many keys."""
    words = 64
    while words * 64 < keys * BITS_PER_KEY and words < MAX_WORDS:
        words *= 2
    return words


def build(keys: DataFrame, cols: list[str], words: int) -> DataFrame:
    """One row with ``bits``, the segments of the filter over the rows of ``keys``; rows with a null key are left out.

    Bits are combined before the shuffle, so at most ``words`` rows per task
    are sent; a segment is gathered from its words, the filter from its
    segments.
    """
    keys = keys.dropna(subset=cols)
    at = keys.select(F.explode(F.array(*_positions([F.col(c) for c in cols], words))).alias("p"))
    packed = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(63).cast("int"))).alias("b"))
    whole = keys.sparkSession.range(words).withColumnRenamed("id", "w").join(packed, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("bigint")).alias("b"))
    segment = whole.groupBy(F.floor(F.col("w") / SEGMENT).alias("s")).agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))
    return segment.agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "words"))), lambda x: x["words"]).alias("bits"))


def might_contain(bits: Column, cols: list[str], words: int) -> Column:
    """False only for keys that were certainly not put in."""
    hit = F.lit(True)
    for p in _positions([F.col(c) for c in cols], words):
        w = F.shiftright(p, 6).cast("int")
        word = F.get(F.get(bits, F.shiftright(w, SEGMENT.bit_length() - 1)), w.bitwiseAND(F.lit(SEGMENT - 1)))
        hit = hit & (F.call_function("shiftright", word, p.bitwiseAND(63).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return hit
