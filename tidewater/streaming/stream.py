"""Streams: keyed dedupe, time buckets, and mutations that arrive before their target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.ingest import floor_bucket


def dedupe(messages: DataFrame, key: tuple[str, ...] = ("source", "raw_ts"), watermark: str | None = None, time: str = "ts") -> DataFrame:
    """One message for each key over restarts. Without a watermark state is kept for good, as late data has no limit;
    with one, keys are forgotten after it - a deviation that has to be asked for."""
    return messages.withWatermark(time, watermark).dropDuplicatesWithinWatermark(list(key)) if watermark else messages.dropDuplicates(list(key))


def bucket_counts(messages: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return messages.groupBy(floor_bucket(F.col("raw_ts")).alias("coarse_ts"), *by).agg(F.count(F.lit(1)).alias("n"))


def apply_mutations(stream: DataFrame) -> DataFrame:
    """stream (source, raw_ts, kind, body, target_ts, arrival) to versions of messages, as update rows.

    State is one small row for each message or target (source and its raw_ts), kept for good, as late data has no limit:
    a mutation waits there for its message. A message comes out again whenever it changes; the last version counts.
    """
    is_message, is_edit = F.col("kind") == "message", F.col("kind") == "edit"
    per = stream.groupBy("source", F.when(is_message, F.col("raw_ts")).otherwise(F.col("target_ts")).alias("at")).agg(
        F.bool_or(is_message).alias("there"), F.min_by(F.when(is_message, F.col("body")), F.when(is_message, F.col("arrival"))).alias("body"), F.bool_or(F.col("kind") == "delete").alias("retracted"),
        F.max_by(F.when(is_edit, F.col("raw_ts")), F.when(is_edit, F.col("arrival"))).alias("superseded_by"),
    )
    return per.where("there").select("source", F.col("at").alias("raw_ts"), F.when(F.col("retracted"), "").otherwise(F.col("body")).alias("body"), "retracted", "superseded_by")


def observed(messages: DataFrame, handles: str = "handle") -> DataFrame:
    """The handles seen so far, each once: what a receiver notes beside the messages of its group."""
    return messages.where(F.coalesce(F.trim(handles), F.lit("")) != "").select(F.trim(handles).alias(handles)).dropDuplicates([handles])


def last_seen(messages: DataFrame, by: str = "group_id") -> DataFrame:
    """by, last_seen: the raw_ts of the message handled last, which need not be the latest."""
    return messages.groupBy(by).agg(F.max_by("raw_ts", "arrival").alias("last_seen"))


def drained(spark: SparkSession, stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """What a stream gives once its input is read through: written under path, read as a batch."""
    if mode == "update":  # a folder for each batch: its rows stand for those of the same key before

        def add(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")

        stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    elif mode == "append":
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    else:

        def put(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out")

        stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def windows(stream: DataFrame, path: str, each: Callable[[DataFrame, str], None]) -> None:
    """each(rows, window) for each micro-batch of what has arrived; path is the checkpoint in a shared folder.

    A window is committed after `each` has returned. Where it raises - a refusal, a lost driver - the window stays pending
    and comes again with the same name and rows, so writes have to be idempotent by window. A blocked window is one
    that `each` puts into quarantine and returns from.
    """
    started = stream.writeStream.foreachBatch(lambda rows, i: each(rows, f"w{i}")).option("checkpointLocation", path).trigger(availableNow=True).start()
    started.awaitTermination()
