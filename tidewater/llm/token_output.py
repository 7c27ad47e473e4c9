"""Token ids in ORC: run-length-encoded integers, a row index and Bloom filters on doc_id, prefix sums for seeking."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import new_path, sliced, table, texts, utf8
from tidewater.llm.tokens import TOKENIZER, token_bytes

SCHEMA = "part int, row long, doc_id long, local_start long, n_tokens long, ids array<int>"


def write_orc(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = 2, stripe_bytes: int = 64 << 20, index_stride: int = 1000) -> str:
    """Writes a row for each document, in ascending doc_id order over all files, and returns the path.

    Texts are dealt out by ranges of doc_id and sorted there; part and row number the files and their rows in that
    order, and local_start counts the ids before a row in its part. Null text is empty (only the end id); null
    doc_ids come first; rows that repeat a doc_id stay, by a hash of their text, so that many of one doc_id are dealt out
    too; an empty table gives no rows. Other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, row, start = token_bytes(tokenizer), TaskContext.get().partitionId(), 0, 0
        for b in sliced(batches):
            ids = [np.frombuffer(x, "<i4") for x in memo.of(utf8(b), end_id)]
            n = np.array([len(x) for x in ids], np.int64)
            ends = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(row, row + len(n))), b["doc_id"], pa.array(start + ends[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(ids)))],
                names=["part", "row", "doc_id", "local_start", "n_tokens", "ids"],
            )
            row, start = row + len(n), start + int(ends[-1])

    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").drop("text_hash")
    (
        ordered.mapInArrow(encode, SCHEMA).write.option("orc.compress", "LZ4").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01)
        .option("orc.row.index.stride", index_stride).option("orc.stripe.size", stripe_bytes).option("orc.create.index", "true").orc(path)
    )
    return path


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """The rows with `start`, the ids of all documents before. Stripes are read in parallel; a filter on doc_id prunes
    by the row index and Bloom filters. Parts are as many as files, so their offsets can be broadcast."""
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.expr("sum(n) over (order by part rows between unbounded preceding and 1 preceding)"), F.lit(0).cast("long"))
    return rows.join(F.broadcast(sums.select("part", before.alias("__before"))), "part").withColumn("start", F.col("local_start") + F.col("__before")).drop("__before")


def with_crc(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["ids"]
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [zlib.crc32(values[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["start"], pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as the ORC files have them."""
    path = write_orc(table(spark, sf_dir, "documents"), new_path(spark, "tokens"))
    return with_crc(read_orc(spark, path))
