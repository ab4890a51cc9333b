"""Helpers that the corpus operators share: shared storage, batching by bytes, table readers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir of the session.

    Only on one machine (tests), where the session names none, a temporary folder is made and set; a cluster without
    that setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors and the driver share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="cairnwork-")
        atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_local["dir"])
    return "file://" + _local["dir"]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """(file system, path) of a folder in the shared storage, as pyarrow knows it; local paths without a scheme too."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def materialize(df: DataFrame, name: str, codec: str = "zstd", through: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, columns: str = "") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors.

    Each task attempt writes a Parquet file of its own name and reports it; just the files that successful attempts
    reported are read, so what failed or repeated attempts leave behind does no harm. The files are written by the
    Python workers: on a file system without Hadoop's native library the JVM would start a process for each file.
    The driver gets one name a file with rows, as it does from any listing of a table that Spark reads.
    With `through`, which gives rows of `columns`, the worker that writes runs it on the rows of df; under mapInArrow
    it would take a second worker for each task, and its rows would go through the JVM.
    """
    spark = df.sparkSession
    folder = shared_path(spark, name)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        out = path = None
        fs, base = filesystem(folder)
        for batch in through(batches) if through else batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(base, recursive=True)
                path = f"part-{uuid.uuid4().hex}.parquet"
                out = pq.ParquetWriter(f"{base}/{path}", batch.schema, filesystem=fs, compression=codec, use_dictionary=False)
            out.write_batch(batch)
        if out is not None:
            out.close()
            trim()
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    paths = sorted(f"{folder}/{r['path']}" for r in df.mapInArrow(write, "path string").collect())
    schema = columns if through else df.schema
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salt_of(*cols: str, n: int = 32):
    """A salt from a row's own content, so that a recomputed task gives the same one."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def trim() -> None:
    """Give freed memory back to the system, so that a worker kept for its next task holds little meanwhile."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Split Arrow batches so that `column` has about max_bytes in each slice (a longer row goes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        total, start = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > max_bytes:
                yield batch.slice(start, i - start)
                total, start = 0, i
            total += size
        yield batch.slice(start)
        del batch
        trim()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix style): equal in, equal out, well spread."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# \p{L} and \p{N} among ASCII and U+00A1 to U+024F, as classes for `re`
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼½¾"

WHITE = re.compile(r"[\x20\x09-\x0D]+")


class KeyFilter(NamedTuple):
    """A Bloom filter of one hash: bitmap has 2^bits bits, in rows of 4 KiB."""

    bitmap: DataFrame
    bits: int


def _slot(key, bits: int):
    return F.pmod(F.xxhash64(key), F.lit(1 << bits)) + F.lit(1)


def key_filter(keys: DataFrame, column: str, least: int = 20, most: int = 29) -> KeyFilter:
    """A bit set for every key, 16 bits a key or more up to 2^most bits (64 MiB), which bounds the broadcast; keys is counted."""
    bits = min(most, max(least, (16 * keys.count()).bit_length()))
    slot = _slot(F.col(column), bits)
    bitmap = (
        keys.select(F.bitmap_bucket_number(slot).alias("__bucket"), F.bitmap_bit_position(slot).alias("__bit"))
        .groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bitmap"))
    )
    return KeyFilter(bitmap, bits)


def flagged(rows: DataFrame, column: str, known: KeyFilter, flag: str) -> DataFrame:
    """rows with a boolean: whether the key may be in the filter. No row is shuffled."""
    slot = _slot(F.col(column), known.bits)
    joined = rows.withColumns({"__bucket": F.bitmap_bucket_number(slot), "__bit": F.bitmap_bit_position(slot)}).join(F.broadcast(known.bitmap), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__bitmap", F.shiftright(F.col("__bit"), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = joined.withColumn("__byte", byte).withColumn(flag, F.coalesce(F.expr("shiftright(__byte, cast(__bit % 8 as int)) & 1 = 1"), F.lit(False)))
    return found.drop("__bucket", "__bit", "__bitmap", "__byte")


def maybe_in(rows: DataFrame, column: str, known: KeyFilter) -> DataFrame:
    """Rows whose key may be in the filter: all that are, few others."""
    return flagged(rows, column, known, "__maybe").filter("__maybe").drop("__maybe")


def salted_lookup(rows: DataFrame, unique: DataFrame, key: str, spread: str, how: str = "left", salts: int = 16) -> DataFrame:
    """rows joined with `unique` (one row a key), a hot key's rows being spread over `salts` tasks by the column `spread`."""
    many = unique.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", salt_of(spread, n=salts)).join(many, [key, "__salt"], how).drop("__salt")
