"""Sinks: appended metrics, versioned snapshots, quarantine, page outcomes, files of an archive."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def record_run(row: DataFrame, path: str, ts: str) -> None:
    """A metrics row appended as a JSON line, with its time given."""
    row.withColumn("ts", F.lit(ts)).write.mode("append").json(path)


def write_version(df: DataFrame, path: str, version: int) -> str:
    """A snapshot under a folder of its own: readers of the one before aren't disturbed."""
    out = f"{path}/v={version}"
    df.write.mode("errorifexists").parquet(out)
    return out


def write_quarantine(rows: DataFrame, path: str) -> None:
    """Blocked payloads by rule."""
    rows.write.mode("append").partitionBy("violation").json(path)


def write_topics(topics: DataFrame, path: str) -> None:
    """A folder for each topic key, with its JSON."""
    topics.write.mode("overwrite").partitionBy("topic_key").json(path)


def page_outcome(existing: Column, text: Column, overwrite: bool = False) -> Column:
    """What writing a page does: created, unchanged, replaced or collided."""
    return F.when(existing.isNull(), "created").when(existing == text, "unchanged").when(F.lit(overwrite), "replaced").otherwise("collided")


def appended(existing: Column, header: Column, body: Column) -> Column:
    """A page with a body appended, begun with a header where it isn't there."""
    return F.concat(F.coalesce(existing, header), body)


# Keys whose values never go to a log; the second line is our own addition.
FORBIDDEN_LOG_KEYS = ("body", "message_text", "text", "content", "transcript",
                      "message", "quote", "name", "phone")


def safe_log(fields: Column) -> Column:
    """A map of log fields without the content of those that may hold some."""
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).isin(*FORBIDDEN_LOG_KEYS), F.lit("<redacted>")).otherwise(v))


class Refused(ValueError):
    """A write outside of what this engine owns."""


class Folder:
    """Files of one folder of an archive, on any store that Spark reaches, each written whole and then renamed.

    For what a window's quotas bound - pages, topics, the dashboard -, written by the driver. The folder has to be one of
    those owned, and the archive must not lie in a foreign one.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str, owned: Sequence[str], foreign: str | None = None, suffix: str = ".md"):
        self._jvm, self._conf, self.suffix = spark._jvm, spark._jsc.hadoopConfiguration(), suffix
        self._fs = self._path(root).getFileSystem(self._conf)
        self._local = self._fs.getScheme() == "file"
        if self._local:  # without checksum files, as pages are edited by hand too
            self._fs = self._fs.getRaw()
        self.root = self._real(root)
        if not self._fs.exists(self._path(self.root)) or not self._fs.getFileStatus(self._path(self.root)).isDirectory():
            raise Refused("the archive is not there")
        if folder not in owned:
            raise Refused(f"the folder '{folder}' isn't owned")
        if foreign and self._inside(self.root, self._real(foreign)):
            raise Refused("the archive lies in a foreign one")
        self.target = self._real(posixpath.join(self.root, folder))
        if not self._inside(self.target, self.root) or self.target == self.root:
            raise Refused(f"the folder '{folder}' lies outside of the archive")

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _real(self, path: str) -> str:
        uri = self._fs.makeQualified(self._path(path)).toUri()
        plain = posixpath.normpath(uri.getPath())
        if self._local:
            return os.path.realpath(plain)
        return f"{uri.getScheme()}://{uri.getAuthority() or ''}{plain}"

    @staticmethod
    def _inside(path: str, folder: str) -> bool:
        return path == folder or path.startswith(folder.rstrip("/") + "/")

    def resolve(self, stem: str) -> str:
        path = self._real(f"{self.target}/{stem}{self.suffix}")
        if stem in ("", ".", "..") or stem.startswith("/") or not self._inside(path, self.target):
            raise Refused("a write outside of the folder")
        return path

    def read(self, stem: str) -> str | None:
        path = self._path(self.resolve(stem))
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, stem: str, text: str) -> None:
        path = self.resolve(stem)
        part = self._path(f"{posixpath.dirname(path)}/.{posixpath.basename(path)}.{uuid.uuid4().hex}")
        try:
            stream = self._fs.create(part, True)
            try:
                stream.write(bytearray(text.encode("utf-8")))
            finally:
                stream.close()
            if self._local:
                if not self._fs.rename(part, self._path(path)):
                    raise OSError(f"{stem} was not written")
            else:
                options = self._jvm.org.apache.hadoop.fs.Options.Rename
                how = self._jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
                how[0] = options.OVERWRITE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), self._conf).rename(part, self._path(path), how)
        except BaseException:
            self._fs.delete(part, False)
            raise

    def write(self, stem: str, text: str, overwrite: bool = False) -> str:
        """What page_outcome says; unchanged and collided write nothing."""
        there = self.read(stem)
        if there is not None and not overwrite:
            return "unchanged" if there == text else "collided"
        self._put(stem, text)
        return "created" if there is None else "replaced"

    def append(self, stem: str, text: str, header: str = "") -> str:
        there = self.read(stem)
        self._put(stem, (header if there is None else there) + text)
        return "created" if there is None else "replaced"

    def write_changed(self, stem: str, text: str) -> bool:
        """Whether the text differed from what was there, and so was written."""
        if self.read(stem) == text:
            return False
        self._put(stem, text)
        return True
