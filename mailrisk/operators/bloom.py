"""A Bloom filter of a table's keys, applied to rows before they are shuffled to meet it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.session import MAX_BROADCAST_BYTES

#: Bits per key, and hashes: half a percent of other keys get through.
BITS_PER_KEY, HASHES = 12, 6
#: Bits per key below which a filter of the greatest size lets too much through to be worth its pass.
LEAST_BITS = 6


@dataclass(frozen=True)
class Bloom:
    bits: int
    words: np.ndarray  # of 64 bits each

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """False where a key with this hash was certainly not put in."""
        found = np.ones(len(hashes), bool)
        one, two = hashes & 0xFFFFFFFF, (hashes >> 32) & 0xFFFFFFFF
        for i in range(HASHES):
            place = (one + i * two) % self.bits
            found &= (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
        return found


def build(table: DataFrame, key: str, max_bytes: int = MAX_BROADCAST_BYTES) -> Bloom | None:
    """The filter of all keys that are not null, of at most max_bytes; None if that is too small for their number.

    Each task joins the bits of its keys by word, and the words are joined again: what reaches the
    driver is the filter, never a key.
    """
    keys = table.where(F.col(key).isNotNull())
    n = keys.count()
    bits = min(64 * max(1, -(-n * BITS_PER_KEY // 64)), 8 * max_bytes // 64 * 64)
    if bits < LEAST_BITS * n:
        return None
    hashed = keys.select(F.xxhash64(key).alias("h"))
    one, two = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("h", 32)
    places = F.explode(F.array(*[(one + i * two) % bits for i in range(HASHES)])).alias("place")
    set_bits = hashed.select(places).groupBy(F.expr("place div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("held"))
    got = set_bits.toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got["word"].to_numpy()] = got["held"].to_numpy().view(np.uint64)
    return Bloom(bits, words)


def may_hold(bloom: Bloom, key: Column, df: DataFrame) -> Column:
    """True where the key may have been put in; the filter is broadcast once. A null key never is."""
    shared = df.sparkSession.sparkContext.broadcast(bloom)

    def _may_hold(hashes: pa.Array) -> pa.Array:
        return pa.array(shared.value.holds(hashes.to_numpy(zero_copy_only=False)))

    return key.isNotNull() & F.arrow_udf(_may_hold, "boolean")(F.xxhash64(key))


def sieve(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The rows whose key the table may have, without a shuffle: all that it has, and few others."""
    bloom = build(table, key)
    return rows if bloom is None else rows.where(may_hold(bloom, F.col(key), rows))
