"""The message store as tables: keyed inserts, mutations in any order, pending windows, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("source", "raw_ts")


def first_arrivals(rows: DataFrame, key: tuple[str, ...] = KEY, order: str = "arrival") -> DataFrame:
    """One row for each key, the first to arrive: an aggregate, so copies meet map-side."""
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct(order, *(c for c in cols if c != order and not _unordered(rows, c)))).alias("r")).select(*key, "r.*")


def _unordered(rows: DataFrame, c: str) -> bool:
    return rows.schema[c].dataType.typeName() in ("map", "variant")


def insert_or_ignore(store: DataFrame, new: DataFrame, key: tuple[str, ...] = KEY, order: str = "arrival") -> DataFrame:
    """The new rows that the store lacks, first arrivals only."""
    return first_arrivals(new, key, order).join(store.select(*key), list(key), "left_anti")


def latest_by_key(rows: DataFrame, key: str = "key", value: str = "value", order: str = "arrival") -> DataFrame:
    """The last value put for each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def apply_mutations(messages: DataFrame, mutations: DataFrame) -> DataFrame:
    """Deletes and edits applied to their targets, whichever came first: retracted with an empty body, or superseded_by.

    Several edits of one target: the last to arrive counts. What has no target waits, by staying out.
    """
    per = mutations.groupBy("source", F.col("target_ts").alias("raw_ts")).agg(
        F.bool_or(F.col("kind") == "delete").alias("__gone"), F.max_by(F.when(F.col("kind") == "edit", F.col("by_ts")), F.when(F.col("kind") == "edit", F.col("arrival"))).alias("__by")
    )
    out = messages.join(per, list(KEY), "left")
    gone = F.coalesce("__gone", F.lit(False))
    return out.withColumns({"retracted": gone, "body": F.when(gone, "").otherwise(F.col("body")), "superseded_by": F.col("__by")}).drop("__gone", "__by")


def pending(store: DataFrame, limit: int = 5000) -> DataFrame:
    """The oldest live messages that no window has taken."""
    live = store.where("processed_window is null and not retracted and superseded_by is null and kind = 'message'")
    return live.orderBy("raw_ts", "source").limit(limit)


def mark_processed(store: DataFrame, taken: DataFrame, window: str) -> DataFrame:
    t = taken.select(*KEY).distinct().withColumn("__t", F.lit(window))
    return store.join(t, list(KEY), "left").withColumn("processed_window", F.coalesce("processed_window", "__t")).drop("__t")


def store_counts(store: DataFrame) -> DataFrame:
    """All, unprocessed (whatever their state), retracted and superseded rows."""
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0)).cast("bigint")
    return store.agg(F.count(F.lit(1)).alias("total"), n(F.col("processed_window").isNull()).alias("pending"), n(F.col("retracted")).alias("retracted"), n(F.col("superseded_by").isNotNull()).alias("superseded"))


def bucket_headers(lines: DataFrame, group: tuple[str, ...] = (), order: tuple[str, ...] = ("raw_ts", "source")) -> DataFrame:
    """Whether a line opens a new time bucket, among the lines that are there: as buckets grow with time, the first of
    each does, so that no task sees more than a bucket."""
    w = Window.partitionBy(*group, "coarse_ts").orderBy(*order)
    return lines.withColumn("header", F.row_number().over(w) == 1)
