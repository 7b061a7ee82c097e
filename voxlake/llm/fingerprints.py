"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct hashes of a text's five-word shingles. Sketches of parts
merge (k smallest of the union) into the sketch of the whole; two sketches estimate resemblance
and containment of their shingle sets, one estimates how many distinct shingles there are.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import U64, map_arrow, read_table, shingle_hashes, shuffle_partitions, text_buffers

K = 256
SHINGLE_WORDS = 5


def sketches(texts: list[str], k: int = K, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sketch of every text (null: empty): sorted, at most k hashes, all of them if it has fewer."""
    data, offsets = text_buffers(pa.array(texts, pa.large_string()))
    return [h[:k] for h in shingle_hashes(data, offsets, size)]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate([a, b]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness; two empty sketches are alike (1.0), exact if both sets fit their sketch."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    return len(np.intersect1d(np.intersect1d(a, union, True), b, True)) / len(union)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1.0 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k))


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").astype(U64)


def merged_sketches(docs: DataFrame, group: str, k: int = K, size: int = SHINGLE_WORDS) -> DataFrame:
    """(group, sketch, distinct_shingles): the sketch of all texts of each value of ``group``, merged across parts.

    Each task merges what it sees of a group; parts are then merged in two steps, by group and a salt and by group, so
    a group that holds most rows is no burden to one task. ``sketch`` is encoded like a document's. Null texts count
    as empty; a null group is a group; an empty table gives none. A sketch is a set, so repeated rows and ties change nothing; long texts are
    taken whole, and other columns don't matter.
    """
    n = shuffle_partitions(docs.sparkSession)

    def part(batches):
        held: dict = {}
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for name, h in zip(batch.column(0).to_pylist(), shingle_hashes(data, offsets, size), strict=True):
                held[name] = merge(held[name], h[:k], k) if name in held else h[:k]
            if len(held) > 1000:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    kind = docs.schema[group].dataType

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), to_arrow_type(kind)), pa.array([encode(h) for h in held.values()])], names=["group", "sketch"])

    def union(pdf: pa.Table) -> pa.Table:
        whole = np.zeros(0, U64)
        for s in pdf.column("sketch").to_pylist():
            whole = merge(whole, decode(s), k)
        return pa.table({"group": pdf.column("group")[:1].cast(to_arrow_type(kind)), "sketch": [encode(whole)], "distinct_shingles": [distinct_count(whole, k)]})

    name = kind.simpleString()
    parts = map_arrow(docs.select(F.col(group).alias("group"), "text"), part, f"group {name}, sketch string")
    salted = parts.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(n)))
    some = salted.groupBy("group", "salt").applyInArrow(union, f"group {name}, sketch string, distinct_shingles double")
    return some.select("group", "sketch").groupBy("group").applyInArrow(union, f"group {name}, sketch string, distinct_shingles double")


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (part, follower, doc_id, text) where within a part, ordered by follower, descending doc_id and
    text, the row after a row is the document that follows it in the whole table.

    Parts are ranges of doc_id. The first row of a part is also sent to the part before as its
    follower row, and the first of all to the last part, so one shuffle of the texts does.
    """
    spark = docs.sparkSession
    n = parts or 4 * shuffle_partitions(spark)
    ids = docs.select("doc_id")
    cuts = ids.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.001) if n > 1 else []
    # Negated, so that parts ascend while ids descend; null ids come last.
    cuts = sorted({-int(c) for c in cuts})
    part = F.lit(0)
    if cuts:
        part = F.coalesce(F.array_position(F.transform(F.array(*map(F.lit, cuts)), lambda c: c >= -F.col("doc_id")), True), F.lit(len(cuts) + 1)).cast("int") - 1
    heads = [(r["part"], r["head"]) for r in ids.groupBy(part.alias("part")).agg(F.max("doc_id").alias("head")).orderBy("part").collect()]
    rows = docs.select(part.alias("part"), F.lit(0).alias("follower"), "doc_id", "text")
    if not heads:
        return rows
    # A row per part, however many rows the table has: a bounded broadcast.
    before = [(head, prior) for (prior, _), (_, head) in zip([heads[-1], *heads[:-1]], heads, strict=True)]
    sends = F.broadcast(spark.createDataFrame(before, "head long, prior int"))
    rows = rows.join(sends, F.col("doc_id").eqNullSafe(F.col("head")), "left")
    again = F.when(F.col("prior").isNotNull(), F.array(F.struct(F.col("prior").alias("part"), F.lit(1).alias("follower"))))
    to = F.concat(F.array(F.struct("part", "follower")), F.coalesce(again, F.expr("CAST(array() AS array<struct<part: int, follower: int>>)")))
    rows = rows.select(F.explode(to).alias("to"), "doc_id", "text").select("to.part", "to.follower", "doc_id", "text")
    return rows.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "follower", F.desc_nulls_last("doc_id"), "text")


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("distinct_shingles", pa.float64()), ("next_contained", pa.float64())])


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """For every document its sketch, that of its edited text and their resemblances, and how much of the next
    document it holds (see OUT).

    Null texts count as empty. Rows of equal doc_id are ordered by text, and rows that repeat follow each other; rows
    without a doc_id come last. Long texts are taken whole; other columns don't matter. A table of one row
    is its own follower; an empty table gives an empty result.
    """

    def emit(chunk, nxt):
        texts = [t for _, t in chunk]
        after = [*texts[1:], nxt]
        edited = [t[: len(t) - len(t) // 2] + a[: len(t) // 2] for t, a in zip(texts, after, strict=True)]
        own, other = sketches([*texts, nxt], k), sketches(edited, k)
        cols = (
            [d for d, _ in chunk],
            [len(t) for t in texts],
            [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            [encode(s) for s in own[:-1]],
            [encode(s) for s in other],
            [resemblance(a, b, k) for a, b in zip(own, other, strict=False)],
            [resemblance(a, b, k) for a, b in zip(own, own[1:], strict=False)],
            [distinct_count(a, k) for a in own[:-1]],
            [containment(b, a, k) for a, b in zip(own, own[1:], strict=False)],
        )
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, OUT, strict=True)], schema=OUT)

    def run(batches):
        held, size, part, ended = [], 0, None, False
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                small = batch.slice(lo, 512)
                for p, follower, doc, text in zip(*(small.column(i).to_pylist() for i in range(4)), strict=True):
                    text = text or ""
                    if p != part:
                        if held and not ended:
                            yield emit(held, "")
                        held, size, part, ended = [], 0, p, False
                    if ended:
                        continue
                    if follower or size + len(text) > 1 << 20:
                        if held:
                            yield emit(held, text)
                        held, size = [], 0
                    if follower:
                        ended = True
                    else:
                        held.append((doc, text))
                        size += len(text)
        if held and not ended:
            yield emit(held, "")

    return map_arrow(with_next(docs), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, next_contained double")


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts; awkward rows as in ``fingerprint_edits``."""
    return fingerprint_edits(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
