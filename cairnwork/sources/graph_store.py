"""A graph as base shards and deltas behind a compare-and-set pointer, and its compaction.

A version is a manifest: one row a shard and part, with the part's folder and whether it is base or a numbered delta. Parts are
never changed. Edges are dealt to shards by their source, so that a delta meets the base of its own shard alone and compaction
writes anew the shards that have deltas, not the others.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cairnwork.operators import graph
from cairnwork.plans.storage import cut
from cairnwork.sources import files

EDGE = ["src", "dst", "relation"]
MANIFEST = "shard int, number int, folder string"
SHARDS = 16


class Mismatch(RuntimeError):
    """A compacted graph is not the graph it was made of; nothing is published."""


def _sharded(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("src"), F.lit(shards)).cast("int"))


def _write(rows: DataFrame, root: str) -> str:
    """rows (shard, ...) below a folder of their own, by shard; not dealt anew, so that a shard has a file of each task."""
    folder = f"{root}/part-{uuid.uuid4().hex}"
    rows.write.partitionBy("shard").parquet(folder)
    return folder


def _listed(spark: SparkSession, shards: DataFrame, number: int, folder: str) -> DataFrame:
    return shards.select("shard").distinct().select("shard", F.lit(number).alias("number"), F.lit(folder).alias("folder"))


def create(edges: DataFrame, root: str, shards: int = SHARDS) -> int:
    """The graph's first version, of its distinct edges."""
    rows = _sharded(edges.select(*EDGE).distinct(), shards).withColumn("added", F.lit(True))
    folder = _write(rows, root)
    return files.publish(_listed(edges.sparkSession, edges.sparkSession.read.parquet(folder), 0, folder), root, 0)


def append(delta: DataFrame, root: str, shards: int = SHARDS) -> int:
    """One delta more: edges (src, dst, relation, added), added or removed; each edge once."""
    spark = delta.sparkSession
    at = files.pointer(spark, root)
    held = files.current(spark, root, at)
    number = held.agg(F.max("number")).first()[0] + 1
    folder = _write(_sharded(delta.select(*EDGE, "added"), shards), root)
    return files.publish(held.unionByName(_listed(spark, spark.read.parquet(folder), number, folder)), root, at)


def _parts(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(src, dst, relation, added, shard, number) of a manifest's parts, without the shards that it no longer lists.

    A version has as many folders as there were writes since its last full compaction; their names are all that is collected.
    """
    folders = [(r["number"], r["folder"]) for r in manifest.select("number", "folder").distinct().collect()]
    rows = None
    for number, folder in sorted(folders):
        part = spark.read.parquet(folder).withColumns({"number": F.lit(number), "folder": F.lit(folder)})
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(F.broadcast(manifest.select("shard", "folder")), ["shard", "folder"], "left_semi").drop("folder")


def _merged(parts: DataFrame) -> DataFrame:
    """Each edge as the last part that has it says; partial aggregation first, so a hub's edges are no hot key."""
    last = parts.groupBy("shard", *EDGE).agg(F.max_by("added", "number").alias("added"))
    return last.filter("added").select(*EDGE, "shard")


def edges(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """(src, dst, relation) of a version, the current one unless its number is given.

    A shard without deltas is its base, each edge once; the others are merged.
    """
    manifest = cut(files.current(spark, root, number))
    dirty = manifest.filter("number > 0").select("shard").distinct()
    clean, deltas = manifest.join(dirty, "shard", "left_anti"), manifest.join(dirty, "shard", "left_semi")
    found = [] if clean.isEmpty() else [_parts(spark, clean).select(*EDGE)]
    found += [] if deltas.isEmpty() else [_merged(_parts(spark, deltas)).select(*EDGE)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "src string, dst string, relation string")


def compact(spark: SparkSession, root: str) -> int:
    """Merge deltas into the shards that have some, and publish if nobody else did; the number of the version.

    The checksum of what was written must be that of the graph before, else Mismatch and nothing is published.
    """
    at = files.pointer(spark, root)
    manifest = cut(files.current(spark, root, at))
    dirty = manifest.filter("number > 0").select("shard").distinct()
    if dirty.isEmpty():
        return at
    before = _parts(spark, manifest.join(dirty, "shard", "left_semi"))
    told = Observation()
    folder = _write(_merged(before).observe(told, *map(F.expr, graph.CHECKSUM)).withColumn("added", F.lit(True)), root)
    after = spark.read.schema(before.drop("number", "shard").schema).parquet(folder)
    sums = [told.get, after.agg(*map(F.expr, graph.CHECKSUM)).first().asDict()]  # each edge once on either side
    if sums[0] != sums[1]:
        raise Mismatch(f"{sums[0]} became {sums[1]}")
    written = spark.read.schema("src string, shard int").parquet(folder)
    kept = manifest.join(dirty, "shard", "left_anti").select("shard", "number", "folder")
    return files.publish(kept.unionByName(_listed(spark, written, 0, folder)), root, at)
