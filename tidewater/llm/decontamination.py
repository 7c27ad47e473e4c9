"""Benchmark decontamination by winnowed fingerprints whose hits are extended to whole windows.

A document and an item that share 10 consecutive words share all 6 of its 5-grams, and both keep the least of those 6
hashes as a fingerprint; so every shared window shows up as a shared fingerprint. Around each one, the windows of 10
words are compared with those of the items. Items of fewer than 10 words are windows of their own length; the
guarantee doesn't reach them, so their lengths are looked up at each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import WordHash, grams, row_key, sliced, table, texts, utf8, without_keys, word_hash, written

WINDOW = 10
GRAM = 5
#: Consecutive k-grams of which the least is kept; GRAM + SPAN - 1 = WINDOW is the length that is guaranteed.
SPAN = WINDOW - GRAM + 1
#: Words of items that are broadcast at once; a larger benchmark is worked through in blocks of about so many.
BLOCK_WORDS = 2_000_000

#: A word: digits, letters, and all of U+0080 on; A-Z in lower case.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def fingerprints(g: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Marks the k-grams that are the least of some `span` consecutive ones (of all, if they are fewer)."""
    keep = np.zeros(len(g), bool)
    if not len(g):
        return keep
    span = min(span, len(g))
    k = len(g) - span + 1
    least = g[:k].copy()
    for d in range(1, span):
        np.minimum(least, g[d : d + k], out=least)
    for d in range(span):
        keep[d : d + k] |= g[d : d + k] == least
    return keep


class Windows:
    """The items' windows by length: sorted hashes, each with the items that have it; and the fingerprints of the full ones."""

    def __init__(self, items: list[tuple[object, bytes]]):
        memo, by, prints = WordHash(), {}, []
        for item, text in items:
            w = memo.of(words_of(text))
            if len(w):
                n = min(WINDOW, len(w))
                by.setdefault(n, []).append((np.unique(grams(w, n)), item))
                if n == WINDOW:
                    g = grams(w, GRAM)
                    prints.append(g[fingerprints(g)])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.by = {}
        for n, got in sorted(by.items()):
            h = np.concatenate([x for x, _ in got])
            owner = np.repeat(np.arange(len(got)), [len(x) for x, _ in got])
            order = np.argsort(h, kind="stable")
            self.by[n] = h[order], owner[order], [i for _, i in got]

    def spans(self, w: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Where windows occur in a document's words, as (start, length), and whose they are."""
        found: list[tuple[int, int]] = []
        items: set = set()
        for n, (hashes, owner, names) in self.by.items():
            if len(w) < n:
                continue
            if n == WINDOW:
                g = grams(w, GRAM)
                at = np.flatnonzero(fingerprints(g))
                at = at[_among(g[at], self.prints)]
                if not len(at):
                    continue
                at = np.unique(np.clip(at[:, None] - np.arange(SPAN)[None, :], 0, len(w) - n))
                h = grams(w, n)[at]
            else:
                h = grams(w, n)
                at = np.arange(len(h))
            hit = _among(h, hashes)
            if hit.any():
                found += [(int(x), n) for x in at[hit]]
                same = np.unique(h[hit])
                for a, z in zip(np.searchsorted(hashes, same), np.searchsorted(hashes, same, "right"), strict=True):
                    items |= {names[i] for i in owner[a:z]}
        return found, items


def _among(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(h), bool)
    at = np.searchsorted(of, h)
    at[at == len(of)] = 0
    return of[at] == h


def _hits(windows, tell_all: bool, told: bool):
    """A row for each document (tell_all) or each that has a hit: its words, the runs of hit words, and the items -
    or, with told, what _summary makes of them."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, known = word_hash(), windows.value
        for b in sliced(batches):
            keep, n_words, runs, items = [], [], [], []
            for i, t in enumerate(utf8(b)):
                w = memo.of(words_of(t))
                found, whose = known.spans(w) if len(w) else ([], set())
                if not found and not tell_all:
                    continue
                edges = []
                if found:
                    mark = np.zeros(len(w) + 2, np.int64)
                    for a, n in found:
                        mark[a + 1] += 1
                        mark[a + n + 1] -= 1
                    hit = np.cumsum(mark) > 0
                    edges = np.flatnonzero(hit[1:] != hit[:-1]).tolist()
                keep.append(i)
                n_words.append(len(w))
                runs.append(edges)
                items.append(sorted(whose, key=str))
            cols = [b["row_id"].take(pa.array(keep, pa.int64())), b["doc_id"].take(pa.array(keep, pa.int64()))]
            out = pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64()))], names=["row_id", "doc_id", "n_words", "runs", "items"])
            if told:
                yield from _summary([out])
            else:
                yield out

    return hits


def _told(n_words: int, runs: list[int], items: set) -> tuple[int, int, str]:
    names = sorted(map(str, items))
    return sum(z - a for a, z in zip(runs[::2], runs[1::2], strict=True)), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


def _summary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [_told(n, r, set(i)) for n, r, i in zip(b["n_words"].to_pylist(), b["runs"].to_pylist(), b["items"].to_pylist(), strict=True)]
        hit = [x[0] for x in got]
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], b["n_words"], pa.array(hit, pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.string()), pa.array([x > 0 for x in hit]), b["runs"]],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "runs"],
        )


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of about BLOCK_WORDS words, one block on the driver at a time."""
    block, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        t = (r["text"] or "").encode("utf-8", "replace")
        block.append((r["item_id"], t))
        size += len(t) // 4 + 1
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _merged(runs: list[list[int]]) -> list[int]:
    spans = sorted(x for r in runs for x in zip(r[::2], r[1::2], strict=True))
    out: list[int] = []
    for a, z in spans:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], z)
        else:
            out += [a, z]
    return out


def _merged_summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_summary of rows with the runs of several blocks, merged."""
    for b in batches:
        merged = pa.array([_merged(x) for x in b["all_runs"].to_pylist()], pa.list_(pa.int64()))
        yield from _summary([pa.RecordBatch.from_arrays([b["row_id"], b["doc_id"], b["n_words"], merged, b["items"]], names=["row_id", "doc_id", "n_words", "runs", "items"])])


def contaminated_words(docs: DataFrame, items: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated, and runs (the starts
    and ends of hit words in turn).

    items (item_id, text). Null or empty texts have no words, and as items no windows; repeated item_ids count once,
    equal texts of different items each. An empty benchmark hits nothing. Repeated documents keep a row each, null
    doc_ids stay. Other columns are not read. A benchmark beyond BLOCK_WORDS is worked through in blocks, against all
    documents each time - one block on the driver and in a broadcast, its hits written - and what they hit is merged by
    document.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = texts(docs).select(F.lit(0).cast("long").alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "row_id long, doc_id long, n_words long, runs array<long>, items array<long>"
    told = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, runs array<long>"
    blocks = _item_blocks(items)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return rows.mapInArrow(_hits(spark.sparkContext.broadcast(Windows(first)), True, True), told)
    rows = rows.withColumn("row_id", F.xxhash64("doc_id", "text"))  # equal rows have equal hits, and each counts
    found = None
    for k, block in enumerate(chain([first, second], blocks)):
        known = spark.sparkContext.broadcast(Windows(block))  # one block at a time: what it hits is written, and it goes
        hits, _ = written(rows.mapInArrow(_hits(known, k == 0, False), schema).withColumn("n", F.lit(int(k == 0))), "hits")
        known.destroy()
        found = hits if found is None else found.unionByName(hits)
    each = found.groupBy("row_id", "doc_id").agg(F.max("n_words").alias("n_words"), F.collect_set("runs").alias("all_runs"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.sum("n").cast("int").alias("n"))
    return each.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n").mapInArrow(_merged_summary, told)


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents that hold a window of an item; all columns stay."""
    keyed = docs.withColumn("__row_key", row_key())
    found, _ = written(contaminated_words(keyed.select(F.col("__row_key").alias("doc_id"), "text"), items).where("contaminated").select(F.col("doc_id").alias("__row_key")), "contaminated")
    return without_keys(keyed, found, "__row_key").select(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that occur in windows of the benchmark."""
    return contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("runs")
