"""Files of one piece, written by tasks and read by ranges.

``onefile`` is a sink for rows (offset, data) that say which bytes lie where. Each task writes the rows of its
partition as a part and reports where the part begins and ends; the commit checks that the parts follow each other without gap, and
appends them to the file piece by piece. A task that is tried again writes another part, and only parts
that a commit message names count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.order import running
from .objects import ArrowStore

#: Bytes that the commit copies at a time.
PIECE = 8 << 20
#: Records that a task fetches and decodes at a time.
RECORDS = 1 << 16


@dataclass
class Part(WriterCommitMessage):
    start: int
    end: int
    name: str


class OneFileWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.folder, _, self.name = path.rpartition("/")

    def write(self, iterator):
        store = ArrowStore(self.folder)
        name = f"{self.name}.parts/{uuid.uuid4().hex}"
        start = end = 0
        out = None
        for batch in iterator:
            for offset, data in zip(batch.column("offset").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if out is None:
                    store.files.create_dir(f"{store.root}/{self.name}.parts", recursive=True)
                    out, start, end = store.files.open_output_stream(f"{store.root}/{name}"), offset, offset
                if offset != end:
                    raise ValueError(f"bytes {end} to {offset} of {self.name} are missing")
                out.write(data)
                end += len(data)
        if out is not None:
            out.close()
        return Part(start, end, name if out is not None else "")

    def commit(self, messages):
        store = ArrowStore(self.folder)
        parts = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.start)
        if any(a.end != b.start for a, b in zip(parts, parts[1:], strict=False)) or (parts and parts[0].start != 0):
            raise ValueError(f"the parts of {self.name} don't follow each other")
        store.files.create_dir(store.root, recursive=True)
        with store.files.open_output_stream(f"{store.root}/{self.name}") as out:
            for part in parts:
                with store.files.open_input_stream(f"{store.root}/{part.name}") as piece:
                    while data := piece.read(PIECE):
                        out.write(data)
        if parts:
            store.files.delete_dir(f"{store.root}/{self.name}.parts")

    def abort(self, messages):
        store = ArrowStore(self.folder)
        for m in messages:
            if m is not None and m.name:
                store.files.delete_file(f"{store.root}/{m.name}")


class OneFile(DataSource):
    @classmethod
    def name(cls):
        return "onefile"

    def schema(self):
        return "offset long, data binary"

    def writer(self, schema, overwrite):
        return OneFileWriter(self.options["path"])


def write_file(rows: DataFrame, path: str) -> None:
    """Writes rows (offset, data) as one file; they may lie in any order."""
    rows.sparkSession.dataSource.register(OneFile)
    rows.select("offset", "data").repartitionByRange("offset").sortWithinPartitions("offset").write.format("onefile").mode("append").save(path)


def write_lines(lines: DataFrame, order: list[Column], path: str) -> None:
    """Writes lines (text, and what ``order`` needs; a null text is no line), each with a line feed."""
    data = F.encode(F.concat("text", F.lit("\n")), "UTF-8")
    placed = running(lines.where("text IS NOT NULL").withColumn("data", data), order, F.octet_length("data").cast("long"), "end")
    write_file(placed.select((F.col("end") - F.octet_length("data")).alias("offset"), "data"), path)


def write_records(rows: DataFrame, path: str, header: bytes, size: int, encode: Callable[[pa.RecordBatch], np.ndarray]) -> None:
    """Writes a header and records of ``size`` bytes; ``rows`` have their number k from 0 without gaps, and ``encode`` gives a
    batch's records as bytes (n, size)."""
    first = len(header)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                k = batch.column(batch.schema.get_field_index("k")).to_numpy()
                cuts = np.flatnonzero(np.diff(k) != 1) + 1
                data = encode(batch)
                spans = list(zip([0, *cuts], [*cuts, len(k)], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([first + int(k[a]) * size for a, _ in spans], pa.int64()), pa.array([data[a:b].tobytes() for a, b in spans], pa.binary())], names=["offset", "data"])

    body = rows.repartitionByRange("k").sortWithinPartitions("k").mapInArrow(run, "offset long, data binary")
    head = rows.sparkSession.createDataFrame([(0, bytearray(header))], "offset long, data binary")
    write_file(head.unionByName(body), path)


def read_head(path: str, length: int = 4096) -> bytes:
    folder, _, name = path.rpartition("/")
    data = ArrowStore(folder).get_range(name, 0, length)
    if data is None:
        raise FileNotFoundError(path)
    return data


def read_records(spark: SparkSession, path: str, first: int, size: int, count: int, decode: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Records of a file by ranges, RECORDS at a time: ``decode(k, bytes (n, size))`` makes their rows."""
    folder, _, name = path.rpartition("/")

    def run(batches):
        store = ArrowStore(folder)
        for batch in batches:
            for lo in (batch.column(0).to_numpy() * RECORDS).tolist():
                n = min(RECORDS, count - lo)
                data = store.get_range(name, first + lo * size, n * size)
                if data is None or len(data) != n * size:
                    raise ValueError(f"{path} is short")
                yield decode(np.arange(lo, lo + n), np.frombuffer(data, np.uint8).reshape(n, size))

    return spark.range(-(-count // RECORDS)).mapInArrow(run, schema)
