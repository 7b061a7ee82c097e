"""Keyed objects under a root: a listing that Spark makes, bytes and ranges of bytes that tasks fetch.

Listing and small texts go through Spark's file systems, so any store that Spark reads can be planned over. Tasks
fetch through Arrow's file systems (local paths, HDFS, S3, GCS), which read ranges; other stores can
be given by ``opened``, a function from the root to an object with the methods of ``ArrowStore``.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ArrowStore:
    """Objects of a root by key. A missing object is None; any other failure raises, so that the task is tried again."""

    def __init__(self, root: str):
        self.files, self.root = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        #: Bytes fetched so far.
        self.fetched = 0

    def _open(self, key: str):
        try:
            return self.files.open_input_file(f"{self.root}/{key}")
        except FileNotFoundError:
            return None

    def get(self, key: str) -> bytes | None:
        file = self._open(key)
        if file is None:
            return None
        with file:
            return self._counted(file.read())

    def get_range(self, key: str, start: int, length: int) -> bytes | None:
        """Bytes from ``start`` on, fewer at the object's end."""
        file = self._open(key)
        if file is None:
            return None
        with file:
            return self._counted(file.read_at(max(0, min(length, file.size() - start)), start))

    def put(self, key: str, data: bytes) -> None:
        """Writes an object whole; written again it is the same, so a repeated task does no harm."""
        path = f"{self.root}/{key}"
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        with self.files.open_output_stream(path) as out:
            out.write(data)

    def _counted(self, data: bytes) -> bytes:
        self.fetched += len(data)
        return data


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _hadoop(spark, path)
    return files.exists(at)


def small_text(spark: SparkSession, path: str) -> str | None:
    """A small object such as metadata; None if there is none."""
    if not exists(spark, path):
        return None
    files, at = _hadoop(spark, path)
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(key, length) of all objects below a root, listed by Spark in parallel; nothing is read. Nothing there, no rows."""
    root = root.rstrip("/")
    if not exists(spark, root):
        return spark.createDataFrame([], "key string, length long")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    start = F.length(F.lit(_shown(spark, root))) + 2
    return found.select(F.col("path").substr(start, F.length("path")).alias("key"), "length")


def _shown(spark: SparkSession, root: str) -> str:
    files, at = _hadoop(spark, root)
    return files.makeQualified(at).toString()
