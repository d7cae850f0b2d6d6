"""Exact dedup behind static binary-fuse filters.

Texts are equal when they are the same after each run of white space became one
space. A snapshot is immutable: its digests are dealt to shards by their first
bytes and each shard gets one static three-wise binary-fuse filter of 8-bit
fingerprints, about 9 bits a digest. A batch is grouped by digest first (partial
sums, so a text that makes up a third of the rows is one row a task); its
distinct digests are screened by the filters. Positives join the snapshot's
exact buckets; negatives are new. Then every group's members are compared byte
by byte with the one that stays, and a digest that stands for several texts is
split by the texts themselves.

Defined cases: a null text counts as empty; empty texts are equal to each other
(and a text of white space alone is one space); of equal texts the smallest
doc_id stays, a null doc_id being smaller than any; rows that share a doc_id and
a text are a group like any other, all with keep_id = doc_id and kept = true;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.rows import SPACE, buckets
from folio.session import ship_package, written

#: Digests in a filter's shard, about.
SHARD_KEYS = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; its constants are those of the public MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class FuseFilter:
    """A key sits at one slot in each of three neighbouring segments; its fingerprint is the XOR of the three."""

    def __init__(self, seed: int, segment: int, first: int, table: np.ndarray):
        self.seed, self.segment, self.first, self.table = seed, segment, first, table

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        mixed = _mix(keys + np.uint64(seed))
        start = ((mixed >> np.uint64(32)) * np.uint64(first)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        base = start * np.uint64(segment)
        parts = [base + np.uint64(k * segment) + ((mixed >> np.uint64(11 * k)) & mask) for k in range(3)]
        return np.stack(parts).astype(np.int64), (_mix(mixed) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(np.asarray(keys, np.uint64))
        n = max(len(keys), 1)
        segment = 1 << min(11, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
        room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
        for attempt in range(200):
            first = max(1, math.ceil(room * (1 + attempt / 50) / segment) - 2)
            slots, marks = cls._slots(keys, attempt, segment, first)
            order = cls._peel(slots, (first + 2) * segment)
            if order is not None:
                table = np.zeros((first + 2) * segment, np.uint8)
                for members, own in reversed(order):
                    at = slots[:, members]
                    table[own] = 0
                    table[own] = marks[members] ^ table[at[0]] ^ table[at[1]] ^ table[at[2]]
                return cls(attempt, segment, first, table)
        raise ValueError("no filter was found")

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of keys that have a slot of their own, with that slot; None if some never do."""
        n = slots.shape[1]
        degree = np.bincount(slots.reshape(-1), minlength=size)
        held = np.zeros(size, np.int64)  # XOR of the keys in a slot: the key itself where there is one
        for row in slots:
            np.bitwise_xor.at(held, row, np.arange(n))
        rounds, left = [], n
        ready = np.flatnonzero(degree == 1)
        while len(ready):
            members, at = np.unique(held[ready], return_index=True)
            rounds.append((members, ready[at]))
            left -= len(members)
            touched = slots[:, members].reshape(-1)
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(held, touched, np.tile(members, 3))
            touched = np.unique(touched)
            ready = touched[degree[touched] == 1]
        return None if left else rounds

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        at, marks = self._slots(np.asarray(keys, np.uint64), self.seed, self.segment, self.first)
        return (self.table[at[0]] ^ self.table[at[1]] ^ self.table[at[2]]) == marks

    def to_row(self) -> dict:
        return {"seed": self.seed, "segment": self.segment, "first": self.first, "body": self.table.tobytes()}

    @classmethod
    def from_row(cls, row) -> FuseFilter:
        return cls(int(row["seed"]), int(row["segment"]), int(row["first"]), np.frombuffer(row["body"], np.uint8))


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x[4:12] for x in digests), "<u8")


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def with_shard(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)))


def build_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """One filter a shard from the snapshot's distinct digests."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"shard": pdf["shard"].iloc[0]} | FuseFilter.build(_keys(pdf["digest"])).to_row()])

    return with_shard(snapshot.select("digest"), shards).groupBy("shard").applyInPandas(build, "shard long, seed long, segment long, first long, body binary")


def screen(batch: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The batch's distinct digests with `maybe`: false where the snapshot certainly lacks it."""

    def run(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="shard")
        return rows.assign(maybe=FuseFilter.from_row(own.iloc[0]).has(_keys(rows["digest"])) if len(own) and len(rows) else False)

    rows = with_shard(batch, shards)
    return rows.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(run, "digest binary, first_id long, n long, maybe boolean")


def groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("digest").alias("n"))


def exact_groups(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) over both, from (doc_id, digest) rows."""
    shards = buckets(snapshot.count(), SHARD_KEYS)
    old, new = groups(snapshot), groups(batch)
    filters = written(build_filters(old, shards), "fuse-filters")
    screened = written(screen(new, filters, shards), "screened")
    hits, fresh = screened.where("maybe"), screened.where("NOT maybe")
    met = old.alias("o").join(hits.alias("h"), F.col("o.digest") == F.col("h.digest"), "full").select(
        F.coalesce("o.digest", "h.digest").alias("digest"),
        F.least("o.first_id", "h.first_id").alias("keep_id"),
        (F.coalesce("o.n", F.lit(0)) + F.coalesce("h.n", F.lit(0))).alias("group_size"),
    )
    return met.unionByName(fresh.select("digest", F.col("first_id").alias("keep_id"), F.col("n").alias("group_size")))


#: Stands for a null doc_id while groups are formed.
NO_ID = -(1 << 63)


def exact_dedup(docs: DataFrame, in_snapshot: Column, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document of either part: doc_id, keep_id, group_size, kept, text_sha256."""
    ship_package(docs.sparkSession)
    rows = docs.withColumn("_old", F.coalesce(in_snapshot, F.lit(False)))
    texts = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "_old", normalised(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    texts = texts.select("doc_id", "_old", "text", digest(F.col("text")).alias("digest"))
    digests = written(texts.select("doc_id", "_old", "digest", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "digests")
    found = written(exact_groups(digests.where("_old").select("doc_id", "digest"), digests.where("NOT _old").select("doc_id", "digest")), "groups")

    # The byte check: members of groups against the text that stays, which is one row a digest.
    several = found.where("group_size > 1").select("digest", "keep_id")
    body = texts.select("digest", "doc_id", "text")
    staying = body.join(several.withColumnRenamed("keep_id", "doc_id"), ["digest", "doc_id"]).groupBy("digest", "doc_id").agg(F.min("text").alias("kept_text")).select("digest", "kept_text")
    odd = written(body.join(staying, "digest").where(F.col("text") != F.col("kept_text")).select("doc_id", "digest", "text"), "odd")

    by_digest = digests.drop("_old").join(found, "digest")
    if not odd.isEmpty():
        by_digest = _split_by_text(by_digest, odd)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return by_digest.select(real("doc_id").alias("doc_id"), real("keep_id").alias("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def _split_by_text(rows: DataFrame, odd: DataFrame) -> DataFrame:
    """Where texts of one digest differ, each text is a group."""
    own = odd.groupBy("digest", "text").agg(F.min("doc_id").alias("own_keep"), F.count("digest").alias("own_size"))
    moved = odd.join(own, ["digest", "text"]).select("digest", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "own_keep", "own_size").dropDuplicates()
    less = odd.groupBy("digest").agg(F.count("doc_id").alias("gone"))
    out = rows.join(moved, ["digest", "doc_id", "text_sha256"], "left").join(less, "digest", "left")
    return out.withColumns({"keep_id": F.coalesce("own_keep", "keep_id"), "group_size": F.coalesce(F.col("own_size"), F.col("group_size") - F.coalesce("gone", F.lit(0)))})


def op3_fuse_dedup(docs: DataFrame) -> DataFrame:
    """Documents of even doc_id are the snapshot, the others the batch."""
    return exact_dedup(docs, F.col("doc_id") % 2 == 0)


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n"""
