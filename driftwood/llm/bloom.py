"""Bloom filters that Spark builds and tasks test.

A filter's size is a power of two between fixed limits, so it can be sent to
every executor whatever the input. Beyond the upper limit more keys pass by
chance; the callers confirm exactly what passes, so results stay the same.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS, BITS_PER_KEY = 16, 27, 16


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash (int64 or uint64) in a filter of 2**bits."""
    h = h.view(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def held(filter_: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes a filter (an array of uint64 words) may hold; never misses one that it holds."""
    a, b = places(h, bits)
    one, low = np.uint64(1), np.uint64(63)
    hit = ((filter_[a >> np.uint64(6)] >> (a & low)) & one).astype(bool)
    hit[hit] = ((filter_[b[hit] >> np.uint64(6)] >> (b[hit] & low)) & one).astype(bool)
    return hit


def put(filter_: np.ndarray, h: np.ndarray, bits: int) -> None:
    for x in places(h, bits):
        np.bitwise_or.at(filter_, x >> np.uint64(6), np.uint64(1) << (x & np.uint64(63)))


def bits_for(keys: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (BITS_PER_KEY * max(1, keys) - 1).bit_length()))


def shared_filter(hashes: DataFrame, column: str, keys: int) -> tuple[Broadcast, int]:
    """A filter of all hashes in a bigint column, broadcast, and its bits.

    Executors OR the bits by 64-bit word, so at most 2**MOST_BITS / 64 words
    (32 MB as rows) reach the driver however many keys there are.
    """
    bits = bits_for(keys)
    h, mask = F.col(column), F.lit((1 << bits) - 1)
    place = F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)))
    rows = (
        hashes.select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("set"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["set"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out), bits
