"""Streams over the events table, drained."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.plans.common import Book, millis, table
from tidewater.plans.message_queries import _MS, _MUT
from tidewater.streaming import stream

_b = Book()
QUERIES, ORACLE = _b.queries, _b.oracle


def _shared(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidewater-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _replay(spark, sf_dir, rows):
    """A table as a file stream: written to the shared folder, read as one."""
    path = _shared(spark)
    rows.write.parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{path}/in"), path


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("source"), millis(e, "ts").alias("raw_ts"), "event_id", "event_type", "props")


@_b.query(f"select distinct cast(user_id as varchar) as source, {_MS} as raw_ts from events")
def stream_dedupe(spark, sf_dir):
    e = _events(spark, sf_dir).select("source", "raw_ts")
    s, path = _replay(spark, sf_dir, e.unionByName(e))
    return stream.drained(spark, stream.dedupe(s), path)


@_b.query(f"select {_MS} // 900000 * 900000 as coarse_ts, count(*) as n from events group by 1")
def stream_bucket(spark, sf_dir):
    s, path = _replay(spark, sf_dir, _events(spark, sf_dir).select("source", "raw_ts"))
    return stream.drained(spark, stream.bucket_counts(s), path, "complete")


@_b.query(f"""with {_MUT} select m.source, m.raw_ts, coalesce(gone, false) as retracted, case when gone then '' else props end as body, p.by_ts as superseded_by from m left join p on m.source = p.source and m.raw_ts = p.target""")
def stream_mutation(spark, sf_dir):
    """Messages with mutations that arrive before them."""
    e = _events(spark, sf_dir)
    target = F.lag("raw_ts").over(Window.partitionBy("source").orderBy("raw_ts", "event_id"))
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "edit")
    late = e.select("source", "raw_ts", F.lit("message").alias("kind"), F.col("props").alias("body"), F.lit(None).cast("long").alias("target_ts"), (F.col("event_id") + 1_000_000_000).alias("arrival"))
    early = e.select("source", "raw_ts", kind.alias("kind"), F.lit("").alias("body"), target.alias("target_ts"), F.col("event_id").alias("arrival")).where("kind is not null and target_ts is not null")
    s, path = _replay(spark, sf_dir, late.unionByName(early))
    return stream.drained(spark, stream.apply_mutations(s), path, "update").select("source", "raw_ts", "retracted", "body", "superseded_by")


@_b.query("select distinct event_type as handle from events where event_type <> 'error'")
def stream_observed(spark, sf_dir):
    """What the receiver has seen of a group's handles."""
    e = _events(spark, sf_dir)
    s, path = _replay(spark, sf_dir, e.select(F.when(F.col("event_type") == "error", " ").otherwise(F.concat(F.lit(" "), "event_type")).alias("handle")))
    return stream.drained(spark, stream.observed(s), path)


@_b.query(f"select event_type as group_id, arg_max({_MS}, event_id) as last_seen from events group by 1")
def stream_last_seen(spark, sf_dir):
    """When each group's last message was."""
    s, path = _replay(spark, sf_dir, _events(spark, sf_dir).select(F.col("event_type").alias("group_id"), "raw_ts", F.col("event_id").alias("arrival")))
    return stream.drained(spark, stream.last_seen(s), path, "complete")
