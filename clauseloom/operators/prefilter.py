"""A Bloom filter of one table's keys, so that rows of another one that can't match stay out of the join's shuffle.

The filter is built by an aggregate: tasks send words of bits, OR-ed before and
after the shuffle, and the driver gets at most MOST_BITS / 64 numbers. It is made
only where the counted keys fit MOST_BITS; beyond, every row counts as a possible
match. A row that the filter passes is confirmed by its whole key, one that it
stops has no match: results don't depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits and hashes for each key (about one false match in 300), and the bits of the largest filter: 8 MB.
BITS, HASHES, MOST_BITS = 12, 6, 1 << 26


def _places(h: Column, bits: int) -> Column:
    low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long"))
    return F.array(*[F.pmod(low + high * i, F.lit(bits)) for i in range(HASHES)])


def key_filter(keys: DataFrame, n: int, most: int = MOST_BITS) -> np.ndarray | None:
    """Words of the filter of n keys, a table with the column h of 64-bit hashes; None where it would be too large."""
    bits = 1 << max(10, (n * BITS - 1).bit_length())
    if bits > most:
        return None
    at = keys.select(F.explode(_places(F.col("h"), bits)).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    set_ = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("mask")).toArrow()  # bits / 64 rows at most
    words = np.zeros(bits // 64, np.int64)
    words[set_.column("word").to_numpy()] = set_.column("mask").to_numpy()
    return words.view(np.uint64)


def may_match(words: np.ndarray | None, h: Column, spark) -> Column:
    """Whether a key with this hash may be among the filter's; only the hashes go through Python."""
    if words is None:
        return F.lit(True)
    shared = spark.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        w = shared.value
        x = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
        low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1)
        ok = np.ones(len(x), bool)
        for i in range(HASHES):
            at = (low + high * np.uint64(i)) % np.uint64(len(w) * 64)
            ok &= w[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) > 0
        return pa.array(ok)

    return test(h)
