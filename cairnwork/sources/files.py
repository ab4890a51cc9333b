"""Sources and sinks: source trees, immutable snapshots behind a compare-and-set pointer. Fact streams: operators.facts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.functions import text as T

MOST_BYTES = 2 << 20


def read_tree(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES, extensions: list[str] | None = None, excluded: list[str] | None = None, generated: bool = False) -> DataFrame:
    """(path, size, text) of a tree's files, path relative to root.

    Left out: files over most_bytes, with a zero byte, below folders that are never source, at or below an excluded
    path, of other extensions where some are given, and, unless asked for, generated or vendored ones. Sizes and paths
    are looked at before any content is read.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= most_bytes)
    base = root.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    path: Column = F.substring_index(F.regexp_replace("path", "^[a-z]+:(//)?", ""), base, -1)
    rows = rows.withColumn("path", path).filter(~T.in_directory(F.col("path"), T.IGNORED_DIRECTORIES))
    for x in excluded or []:
        rows = rows.filter(~T.under(F.col("path"), x))
    if extensions:
        rows = rows.filter(T.extension(F.col("path")).isin(extensions))
    if not generated:
        rows = rows.filter(~T.in_directory(F.col("path"), T.GENERATED_DIRECTORIES, lower=True) & ~T.generated_name(F.col("path")))
    rows = rows.filter(F.expr("position(X'00' IN content) = 0")).select("path", F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))
    return rows if generated else rows.filter(~T.generated_content(F.col("path"), F.col("text")))


class Conflict(RuntimeError):
    """Someone else has published meanwhile."""


def _folder(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def pointer(spark: SparkSession, root: str) -> int:
    """The number of the current version; 0 for none."""
    fs, path = _folder(spark, root)
    return max((int(x.getPath().getName()) for x in fs.listStatus(path)), default=0) if fs.exists(path) else 0


def publish(df: DataFrame, root: str, expected: int | None = None) -> int:
    """Write df as an immutable version and point to it, if `expected` (the pointer as it is now, unless given) still holds; the new number.

    Pointers are files named by number that hold a version's name. The next number's file is created only if it is not
    there, which one of two writers can do; the other gets a Conflict, and its version stays unread.
    """
    spark = df.sparkSession
    number = (pointer(spark, root) if expected is None else expected) + 1
    version = f"v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{root}/{version}")
    fs, path = _folder(spark, root)
    if pointer(spark, root) != number - 1:
        raise Conflict(root)
    try:
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(path, str(number)), False)
    except Exception as error:
        if "exist" in str(error).lower():
            raise Conflict(root) from error
        raise
    out.write(bytearray(version.encode()))
    out.close()
    return number


def current(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The current version, or that of a number."""
    name = spark.read.text(f"{root}/pointers/{number or pointer(spark, root)}").first()["value"]
    return spark.read.parquet(f"{root}/{name}")


def export_lines(rows: DataFrame, by: str, order: list[str], folder: str) -> None:
    """JSON lines, one folder for each value of `by`, in a canonical order within each file; ranges of the order, not one task a value."""
    rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).write.partitionBy(by).json(folder)


def publish_shards(rows: DataFrame, key: str, folder: str, shards: int = 64, dirty: list[int] | None = None) -> None:
    """rows below folder/shard=n by a hash of the key; where dirty shards are given only these are written anew."""
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    if dirty is not None:
        sharded = sharded.filter(F.col("shard").isin(dirty))
    sharded.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)
