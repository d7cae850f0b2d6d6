"""Events as a stream: rows of a stale source token go, and each key's counters follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fresh(events: DataFrame, token: str, active: str) -> DataFrame:
    """Only rows of the active source; the others are stale."""
    return events.where(F.col(token) == active)


def progress(events: DataFrame, key: str, done: str, ts: str, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Per key and window: completed, seen and their ratio. Works on a stream and on a table."""
    own = events.withWatermark(ts, late) if events.isStreaming else events
    out = own.groupBy(F.window(ts, every), key).agg(F.count(F.lit(1)).alias("seen"), F.sum(F.when(F.col(done), 1).otherwise(0)).alias("completed"))
    return out.select(F.col("window.start").alias("start"), key, "completed", "seen", F.round(F.col("completed") / F.col("seen"), 4).alias("ratio"))


def running(events: DataFrame, key: str, done: str, order: list[str]) -> DataFrame:
    """Each event of a table with how many of its key's were done by then, and how many there are."""
    own = Window.partitionBy(key)
    return events.withColumns({"completed": F.sum(F.when(F.col(done), 1).otherwise(0)).over(own.orderBy(*order)), "total": F.count(F.lit(1)).over(own)})


def transitions(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """The events at which a key's state changes, with the state before: none at first."""
    own = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumn("before", F.lag(state).over(own))
    return rows.where(~F.col("before").eqNullSafe(F.col(state))).select("*", F.coalesce("before", F.lit("none")).alias("from_state"), F.col(state).alias("to_state")).drop("before")
