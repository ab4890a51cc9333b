"""Structured Streaming forms of the ledger and the runtime aggregate; all end with the input at hand."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.plans.storage import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def finished(df: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what there is; its result as a table. complete: the last state; append: all rows."""
    spark = df.sparkSession
    out, state = _folder(spark, name), _folder(spark, f"{name}-state")
    if mode == "complete":
        def keep(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        query = df.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:
        query = df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def counts_by_kind(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def ledger(events: DataFrame, horizon: str | None = None) -> DataFrame:
    """The first row of each evidence key alone; a row that comes again changes nothing.

    A ledger for ever keeps every key in its state; with a horizon (an interval) a key is forgotten once the watermark
    has passed it by that much, and the state is bounded.
    """
    if horizon is None:
        return events.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    held = events.select("user_id", "event_type", "ts").withWatermark("ts", horizon)
    return held.dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")


def delta(response: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """response with new: whether the ledger's known keys lack it; a key given twice counts once."""
    once = response.dropDuplicates(key)
    return once.join(known.select(*key).distinct().withColumn("__k", F.lit(True)), key, "left").withColumn("new", F.col("__k").isNull()).drop("__k")


def hourly(events: DataFrame) -> DataFrame:
    """Extension: tumbling windows of an hour."""
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
