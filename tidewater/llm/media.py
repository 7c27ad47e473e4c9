"""Media columns: FLAC streams in a binary column, stored losslessly, read back, and cut into seekable PCM blocks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import sliced, table, texts, utf8
from tidewater.llm.flac import decode_each, encode_each, pcm

#: A payload is padded with zero bytes to a positive multiple of this.
MULTIPLE = 64
#: Bytes of payload that are coded, and of media that are decoded, at once.
CODE_AT_ONCE, READ_AT_ONCE = 500_000, 1_500_000


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8, padded to a multiple of MULTIPLE, as FLAC of signed 8-bit samples.

    A byte b is the sample b - 128. Null and empty texts are MULTIPLE zero bytes. Equal texts have equal media. Rows
    that repeat stay, null doc_ids too; other columns are not read.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, most=CODE_AT_ONCE):
            texts = utf8(b)
            padded = [t + bytes(-len(t) % MULTIPLE or (0 if t else MULTIPLE)) for t in texts]
            media = encode_each([np.frombuffer(p, np.uint8).astype(np.int16) - 128 for p in padded])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(store, "doc_id long, n_bytes long, media binary")


def read_features(stored: DataFrame) -> DataFrame:
    """Of each FLAC stream in `media` (doc_id and n_bytes stay): its payload's and its own length and digests, and features.

    feature: frames, least, most, sum and sum of squares of the samples, and sign changes. Null media gives nulls.
    A damaged stream (a wrong CRC or MD5, a cut) fails the task rather than pass for a payload.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "media", READ_AT_ONCE):
            media = b["media"].to_pylist()
            have = [m for m in media if m is not None]
            told = iter([_told(m, i.bits, blocks) for m, (i, blocks) in zip(have, decode_each(have), strict=True)] if have else [])
            rows = [next(told) if m is not None else (None,) * 6 for m in media]
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=["doc_id", "n_bytes", *names])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _told(media: bytes, bits: int, blocks: list) -> tuple:
    x = np.concatenate([s for _, _, s in blocks])
    payload = (x[:, 0] + 128).astype(np.uint8).tobytes() if bits == 8 and x.shape[1] == 1 else pcm(x, bits)
    flat = x.reshape(-1)
    turns = int(((flat[1:] < 0) != (flat[:-1] < 0)).sum())
    feature = f"frames={len(blocks)};min={flat.min()};max={flat.max()};sum={flat.sum()};squares={(flat * flat).sum()};turns={turns}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-MULTIPLE:]), len(media), hashlib.sha256(media).hexdigest(), feature


def pcm_blocks(stored: DataFrame) -> DataFrame:
    """A row for each block of each FLAC stream in `media`: doc_id, block, sample_offset, frame_offset (its byte in
    the stream), n_samples, channels, bits, pcm (interleaved, little-endian, signed). Null media gives no rows."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "block", "sample_offset", "frame_offset", "n_samples", "channels", "bits", "pcm"]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for b in sliced(batches, "media", READ_AT_ONCE):
            have = [(d, m) for d, m in zip(b["doc_id"].to_pylist(), b["media"].to_pylist(), strict=True) if m is not None]
            rows = [(d, k, first, at, len(x), x.shape[1], i.bits, pcm(x, i.bits)) for (d, _), (i, own) in zip(have, decode_each([m for _, m in have]), strict=True) for k, (first, at, x) in enumerate(own)] if have else []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return stored.select("doc_id", "media").mapInArrow(blocks, "doc_id long, block int, sample_offset long, frame_offset long, n_samples long, channels int, bits int, pcm binary")


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as FLAC and read back."""
    return read_features(store_texts(table(spark, sf_dir, "documents")))
