"""Connected components of a graph of long ids, by rounds of large and small stars.

Each round is two joins on the node and ends in a written table, so a lost
executor costs one round. A node of very many links is a skewed join key, which
adaptive execution splits; the smallest neighbour is a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import discard, written


def _star(pairs: DataFrame) -> DataFrame:
    """Small star: of each node and its smaller neighbours, all link to the smallest. pairs: (a, b), a > b."""
    least = pairs.groupBy("a").agg(F.min("b").alias("least"))
    moved = pairs.join(least, "a").where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def _large(pairs: DataFrame) -> DataFrame:
    """Large star: each node's larger neighbours link to the smallest of the node and all its neighbours."""
    both = pairs.union(pairs.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.where("v > u").join(least, "u").where(F.col("v") != F.col("least")).select(F.col("v").alias("a"), F.col("least").alias("b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component. links: (a, b) of longs."""
    pairs = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    sign = None
    for _ in range(rounds):
        new = written(_star(_large(pairs)), "links")
        discard(pairs)
        pairs = new
        # A set of pairs that two rounds running leave alike is a set of stars.
        now = pairs.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
