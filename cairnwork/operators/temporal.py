"""Joins by order and by range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(events: DataFrame, kind: str) -> DataFrame:
    """(event_id, before): for each event the user's latest earlier event of a kind; one sort a user, no join."""
    earlier = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    return events.select("event_id", F.last(F.when(F.col("event_type") == kind, F.col("event_id")), ignorenulls=True).over(earlier).alias("before"))


def overlapping(spans: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """(span_id, window_id): half-open ranges of one key that overlap, by an equi-join on blocks of `width`.

    A pair that shares several blocks is reported by the first.
    """
    block = lambda df: df.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    a = block(spans).select("key", "span_id", F.col("start").alias("s0"), F.col("end").alias("e0"), "block")
    b = block(windows).select("key", "window_id", F.col("start").alias("s1"), F.col("end").alias("e1"), "block")
    hit = a.join(b, ["key", "block"]).filter((F.col("s0") < F.col("e1")) & (F.col("s1") < F.col("e0")))
    return hit.filter(F.col("block") == F.floor(F.greatest("s0", "s1") / width)).select("span_id", "window_id")
