"""Connected components of a table of links: union-find where they are few, else large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.llm import common


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            low, high = sorted((find(u), find(v)))
            parent[high] = low
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "label"])


def components(links: DataFrame, most_rounds: int = 40, few: int = 500_000) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the smallest node it is connected with.

    Up to `few` links, which are counted first, one task joins them by union-find. Beyond that, minima aggregate before the shuffle and hub nodes are joined by salted keys. Every round is written to the shared
    folder. Self-links and repeated links are allowed; a null end makes no link.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = common.materialize(edges, "links")
    if edges.count() <= few:
        return common.materialize(edges.coalesce(1).mapInArrow(_union_find, "node long, label long"), "labels")
    seen = None
    for _ in range(most_rounds):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = common.salted_lookup(both.filter("v > u"), least, "u", "v", "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = common.salted_lookup(large, down, "u", "v", "inner")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = common.materialize(small.filter("u <> v").distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
