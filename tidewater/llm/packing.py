"""Best-fit-decreasing packing whose bin counts are certified by dual-feasible-function bounds.

Each partition packs its own pieces and compares its number of bins with a lower bound. What is left open - the bins
with much free space, and all bins of partitions above their bound that aren't full - is exchanged: those pieces are
dealt out again and packed again, until one partition holds them all, nothing is open, or, from the sixth
round on, one lowers neither the bins nor the open pieces by LEAST_GAIN.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import sliced, table, texts, utf8, written
from tidewater.llm.tokens import TOKENIZER, token_bytes

CAPACITY = 4096
#: Pieces that one partition packs.
GROUP_PIECES = 16_384
#: Rounds that are made whatever they gain, and those that the sequence ids have room for.
LEAST_ROUNDS, ROUNDS = 6, 127
#: The share of its bins or of its open pieces that a round has to save or close for another one to follow.
LEAST_GAIN = 0.001
#: A bin filled to less than this share takes part in the exchange.
CLOSED = 0.97

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", grp long, bin long, offset long, open boolean, bound long, n_bins long"


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins for counts[w] items of each length w: the largest of several dual feasible functions."""
    w = np.arange(len(counts), dtype=np.int64)
    best = -(-int((counts * w).sum()) // capacity)
    for k in range(1, 13):  # u(k): x if (k+1)x is whole, else floor((k+1)x)/k; in units of 1/(capacity k)
        u = np.where((k + 1) * w % capacity == 0, w * k, (k + 1) * w // capacity * capacity)
        best = max(best, -(-int((counts * u).sum()) // (capacity * k)))
    n, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * w)])
    e = np.arange(1, capacity // 2 + 1)  # U(e): 1 above 1-e, x from e to 1-e, else 0
    large, mid = n[capacity + 1] - n[capacity - e + 1], s[capacity - e + 1] - s[e]
    return max(best, int((large + -(-mid // capacity)).max(initial=0)))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin. Longest first; each goes where it leaves least room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        if fit := mask >> n:
            r = n + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if (r := r - n) > 0:
            if not room[r]:
                mask |= 1 << r
            room[r].append(b)
    return bins, offsets, np.array(fills, np.int64)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = 1) -> DataFrame:
    """Each document's ids and end id, cut at multiples of the capacity: where a piece starts, its length and CRC-32.

    Null text is empty (a piece of the end id alone). Other columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, step = token_bytes(tokenizer), 4 * capacity
        for b in sliced(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(b["doc_id"].to_pylist(), memo.of(utf8(b), end_id), strict=True):
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for col, x in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def _packer(capacity: int, last: bool):
    """Packs one partition's pieces; what a rerun does not pack into fewer bins stays as it was."""

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = rows["length"].to_numpy()
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        before = rows["__bin"].to_numpy()
        if "__offset" in rows and len(fills) > len(old := np.unique(before)):  # the rerun is no better: what was stays
            bins, offsets = np.searchsorted(old, before), rows["__offset"].to_numpy()
            fills = np.bincount(bins, lengths).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        is_open = fills < (capacity if len(fills) > bound else int(CLOSED * capacity))
        return rows[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(grp=key[0], bin=bins, offset=offsets, open=False if last else is_open[bins], bound=bound, n_bins=len(fills))

    return packed


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces (of PIECES, lengths from 1 to the capacity) with sequence_id, offset, and whether their partition's bin count is certified."""
    table_, _ = written(pieces, "pieces")
    n = n_bins = table_.count()
    todo = table_.withColumn("__bin", F.xxhash64("doc_id", "piece", "start", "ids_crc32"))
    done: list[DataFrame] = []
    for r in range(ROUNDS):
        groups = max(1, -(-n // group_pieces))
        last = groups == 1 or r == ROUNDS - 1

        dealt = todo.withColumn("grp", F.pmod(F.xxhash64("__bin", F.lit(r)), F.lit(groups)))
        rows, _ = written(dealt.groupBy("grp").applyInPandas(_packer(capacity, last), PACKED), "packed")
        seq = F.lit(r << 56) + (F.col("grp") * (1 << 24)) + F.col("bin")
        rows = rows.withColumn("sequence_id", seq)
        if not last:  # each bin has one piece at 0
            first = F.col("offset") == 0
            now = rows.agg(F.count_if("open").alias("n"), F.count_if(first & F.col("open")).alias("open_bins"), F.count_if(first).alias("bins")).first()
            last = not now["n"] or r + 1 >= LEAST_ROUNDS and now["bins"] > (1 - LEAST_GAIN) * n_bins and now["n"] > (1 - LEAST_GAIN) * n
            n, n_bins = now["n"], now["open_bins"]
        if last:  # what is still open stays as it is
            done.append(rows)
            break
        done.append(rows.where(~F.col("open")))
        todo = rows.where("open").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id").alias("__bin"), F.col("offset").alias("__offset"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", (F.col("n_bins") <= F.col("bound")).alias("certified"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed."""
    return pack(token_pieces(table(spark, sf_dir, "documents")))
