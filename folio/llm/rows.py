"""Small things the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The white space of every contract here.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate() with it lower-cases A-Z alone.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_ascii(col):
    """A-Z to a-z; other letters stay."""
    return F.translate(col, UPPER, UPPER.lower())


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text, empty where it is null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def buckets(rows: int, each: int) -> int:
    """How many buckets of so many rows (or bytes) hold them all."""
    return max(1, -(-int(rows or 0) // each))


#: Hashes are taken over stretches of about so many bytes at once.
STRETCH = 1 << 18
_BYTES = np.random.default_rng(9).integers(0, 1 << 64, 256, np.uint64)
#: An odd factor, so that it has an inverse modulo 2^64.
_FACTOR = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the factor and of its inverse, modulo 2^64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        both = []
        for x in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
            each = np.full(n + STRETCH, x, np.uint64)
            each[0] = 1
            both.append(np.cumprod(each))
        if n > 4 * STRETCH:
            return both[0], both[1]
        _POWERS = both[0], both[1]
    return _POWERS


def hash_stretches(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of the bytes between each start and end, starts ascending: the polynomial of the bytes' numbers, read off running sums."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + STRETCH)))
        low, high = int(starts[at]), int(ends[at:to].max())
        up, down = powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTES[codes[low:high]] * up[: high - low], out=sums[1:])
        own = starts[at:to] - low
        word = (sums[ends[at:to] - low] - sums[own]) * down[own]
        out[at:to] = (word ^ (word >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        at = to
    return out
