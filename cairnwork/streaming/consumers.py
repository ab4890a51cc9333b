"""Consumers of snapshots: each published version is handed to every consumer once, in order, as a stream of pointers.

A consumer's progress is files of its own, named by the version it has finished; a batch that is replayed finds them and does
nothing again. A consumer that fails does not stop the others: they finish, then the batch fails, and its replay hands the
version to those alone that have not finished it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnwork.sources import files

Consumer = Callable[[DataFrame, int], None]


class Failed(RuntimeError):
    """What consumers raised, by name; the others have finished."""


def _path(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def finished(spark: SparkSession, state: str, name: str) -> set[int]:
    """The versions that a consumer has finished."""
    fs, path = _path(spark, state, name)
    return {int(x.getPath().getName()) for x in fs.listStatus(path)} if fs.exists(path) else set()


def hand_out(spark: SparkSession, root: str, state: str, consumers: dict[str, Consumer], numbers: list[int]) -> None:
    """Hand versions to the consumers that have not finished them, by number, then by name."""
    failures: dict[str, str] = {}
    done = {name: finished(spark, state, name) for name in consumers}
    for number in sorted(numbers):
        for name in sorted(consumers):
            if name in failures or number in done[name]:
                continue
            try:
                consumers[name](files.current(spark, root, number), number)
            except Exception as error:  # one consumer's failure is not another's
                failures[name] = f"version {number}: {error}"
                continue
            fs, path = _path(spark, state, name, str(number))
            fs.create(path, False).close()
    if failures:
        raise Failed("; ".join(f"{name}: {said}" for name, said in sorted(failures.items())))


def watch(spark: SparkSession, root: str, state: str, consumers: dict[str, Consumer], checkpoint: str) -> None:
    """Hand out the versions of root that are there by now and not yet handed out; a new call goes on from there."""

    def batch(pointers: DataFrame, _: int) -> None:
        numbers = [int(r["number"]) for r in pointers.selectExpr("substring_index(_metadata.file_path, '/', -1) AS number").collect()]  # one a version
        hand_out(spark, root, state, consumers, numbers)

    stream = spark.readStream.schema("value string").text(f"{root}/pointers")
    stream.select("value", "_metadata").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
