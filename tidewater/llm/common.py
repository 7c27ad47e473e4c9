"""What the operators share: tables in the shared folder, word hashing, and joins that survive a hot key."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words kept in one process's memo before it is emptied; a bound on memory, without effect on results.
MEMO_ENTRIES = 200_000

#: Bytes of text in one piece of a batch that is worked on at once.
SLICE_BYTES = 4_000_000


def texts(df: DataFrame) -> DataFrame:
    """df, with Arrow batches in its session bounded by bytes: rows hold whole texts, and ten thousand of them (Spark's
    default, which counts rows only) are tens of MB in the JVM and again in each worker."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one only where it is unset and the
    master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files that no plan needs any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


_KEPT: dict = {}


def kept(key: str, make):
    """What make() gives, kept by this process until something else is: a worker's tasks share one memo, and only one."""
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _KEPT[key] = make()
    return _KEPT[key]


class WordHash(dict):
    """64-bit hash of a word; filled as words come, emptied at MEMO_ENTRIES."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hash() -> WordHash:
    return kept("words", WordHash)


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words; empty where there are fewer."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(k, np.uint64)
    for i in range(n):
        h = (h ^ words[i : i + k]) * _ODD[i % 5] + _ODD[(i + 2) % 5]
        h ^= h >> np.uint64(29)
    return mix(h)


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `most` bytes of text, a row at least, so that long texts don't add up in memory."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0), dtype=np.int64)
        if not len(lengths):
            continue
        piece = np.cumsum(lengths) // most
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(lengths)], strict=True):
            yield batch.slice(int(a), int(b - a))
    pa.default_memory_pool().release_unused()


def utf8(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in batch[text].cast(pa.binary()).to_pylist()]


def hot_split_join(big: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int, how: str = "inner", most: int = 1000) -> DataFrame:
    """big joined with keyed (a row for each key, with the number `count` of big's rows that have it).

    Keys that hold over 1/most of big's rows (at most `most` of them, so small enough to broadcast) join by
    broadcast, the others by shuffle: no task gets all rows of a hot key.
    """
    least = max(total // most, 10_000)
    hot = keyed.where(F.col(count) > least)
    names = [c for c in keyed.columns if c not in on]
    flags = F.broadcast(hot.select(*on, F.lit(True).alias("__hot")))
    split = big.join(flags, on, "left")
    a = split.where(F.col("__hot")).drop("__hot").join(F.broadcast(hot), on, "inner")
    b = split.where(F.col("__hot").isNull()).drop("__hot").join(keyed.where(F.col(count) <= least), on, how)
    cols = [*big.columns, *names]
    return a.select(*cols).unionByName(b.select(*cols))


def bit_flag(big: DataFrame, keys: DataFrame, on: str, flag: str, bits: int = 23) -> DataFrame:
    """big's rows with a flag: whether their key may be among the keys, by a bitmap of 2**bits bits.

    The bitmap is at most 2**(bits - 6) rows of a word each, whatever the number of keys, so it can be broadcast. The
    flag may hold for other keys too, which an exact join after it sorts out; it always holds for the keys given.
    """
    h = F.pmod(F.xxhash64(F.col(on)), F.lit(1 << bits))
    words = keys.select(h.alias("__h")).groupBy(F.shiftright("__h", 6).alias("__w")).agg(F.expr("bit_or(shiftleft(1L, cast(__h & 63 as int)))").alias("__bits"))
    found = big.withColumn("__h", h).withColumn("__w", F.shiftright("__h", 6)).join(F.broadcast(words), "__w", "left")
    return found.select(*big.columns, F.expr("coalesce((shiftrightunsigned(__bits, cast(__h & 63 as int)) & 1) = 1, false)").alias(flag))


def bit_prefilter(big: DataFrame, keys: DataFrame, on: str, bits: int = 23) -> DataFrame:
    """big's rows whose key may be among the keys, as bit_flag says."""
    return bit_flag(big, keys, on, "__may", bits).where("__may").drop("__may")


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, from batches that are sorted by the key."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        k = b[key].to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        starts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for a, z in zip(starts[:-1], starts[1:], strict=True):
            if held and k[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(int(a), int(z - a)))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)


def row_key():
    """A hash of doc_id and text, the same for repeated rows only."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("\u0000null")))


def held_out(doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod 5 is 0; false for a null doc_id."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def hash_sample(rows: DataFrame, by: str, key: str, most: int, counts: dict) -> DataFrame:
    """About `most` rows of each value of `by` (all, where there are fewer), by a hash of the key."""
    share = F.lit(0.0)
    for v, n in counts.items():
        share = F.when(F.col(by) == F.lit(v), F.lit(min(1.0, most / n))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 20)) < share * (1 << 20))


def without_keys(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose key isn't among the keys; a null key stays. Only rows that a fixed-size bitmap marks are joined."""
    flagged = bit_flag(rows, keys, on, "__may")
    rest = flagged.where("__may").join(keys.select(on).distinct(), on, "left_anti")
    return flagged.where(~F.col("__may")).select(*rows.columns).unionByName(rest.select(*rows.columns))


def bits_for(keys: int, most: int = 25) -> int:
    """Bits (as a power of two) of a bitmap with about eight for each key, within a bound."""
    return min(most, max(16, (8 * max(keys, 1) - 1).bit_length()))


def once_of_kept(rows: DataFrame, kept: DataFrame, marked: DataFrame, on: str, bits: int = 23) -> DataFrame:
    """The rows whose key is among the kept ones, one row for each key.

    Each row's key has to be in kept or in marked, and in both where it is kept and repeated. A row that the bitmap of
    marked doesn't know stays and one that the bitmap of kept doesn't know goes, so that only rows which both may know
    shuffle, once: neither the rows that stay nor those that go, however large their share.
    """
    flagged = bit_flag(bit_flag(rows, marked, on, "__out", bits), kept, on, "__in", bits)
    open_ = flagged.where(F.col("__out") & F.col("__in")).select(*rows.columns).dropDuplicates([on])
    rest = open_.join(kept.select(on).distinct(), on, "left_semi")
    return flagged.where(~F.col("__out")).select(*rows.columns).unionByName(rest.select(*rows.columns))
