"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Large-item matching: no bin can hold more than two pieces above a third of its capacity, so
those are matched greedily, the largest with the largest that still fits. Smaller pieces then
go, largest first, into the tightest gap that takes them, and into new bins when none does.

Lengths are small integers, so the plan is made on the histogram of lengths: at most
``capacity`` rows on the driver for any corpus. A plan step places k pieces of one length in
each of m bins; each step uses up a length or a group of equal bins, so the steps are bounded by
the capacity too. Pieces find their step by their rank among those of equal length. Ranks are
counted within salted sub-groups, so one very frequent length is spread over many tasks.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, read_table, shuffle_partitions

CAPACITY = 2048
END_ID = 0
CACHE_WORDS = 100_000
BATCH_ROWS = 64

# ---------------------------------------------------------------- tokens

_LAST_MARK = re.compile(rb"[.,](?<=[a-z0-9][.,])(?=[ \t\n\x0b\x0c\r]|\Z)")


class _Cache(dict):
    """Ids of chunks in two generations of CACHE_WORDS at most: what was asked for lately stays, whatever the texts hold."""

    tokenizer = None
    older: dict[bytes, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = _encode(self.tokenizer, chunk)
        if len(chunk) <= 48:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


_cache = _Cache()
_loaded: dict[str, object] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str | None):
    path = path or tokenizer_path()
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded.clear(), _cache.clear(), _cache.older.clear()
        _loaded[path] = _cache.tokenizer = Tokenizer.from_file(path)
    return _loaded[path]


def token_bytes(text: str, path: str | None = None) -> bytes:
    """Little-endian 32-bit ids of a text.

    This vocabulary drops white space and no token spans it, so the ids of a text are those of
    its white-space-delimited chunks, one after another; chunks seen before come from a cache.
    It ignores case too and keeps letters and digits apart from punctuation, so chunks are
    lower-cased in A to Z and a single stop or comma at a word's end is a chunk of its own. Texts
    that may hold one of its control strings, which are told apart by case, are left as they are.
    """
    _tokenizer(path)
    data = text.encode("utf-8", "replace")
    if b"<|" not in data:
        data = _LAST_MARK.sub(rb" \g<0>", data.lower())
    return b"".join(map(_cache.__getitem__, data.split()))


#: A chunk of small Latin letters alone is one word to this tokenizer, already in its normal form.
_PLAIN_WORD = re.compile("[a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTER_OF_BYTE = _byte_letters()


def _encode(tok, chunk: bytes) -> bytes:
    """Ids of a chunk: a plain word by the tokenizer's model alone, another by the whole tokenizer."""
    word = chunk.decode()
    if _PLAIN_WORD.fullmatch(word):
        if len(word) != len(chunk):
            word = "".join(map(_LETTER_OF_BYTE.__getitem__, chunk))
        ids = [t.id for t in tok.model.tokenize(word)]
    else:
        ids = tok.encode(word, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def tokenize_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces of every document's ids and a closing id 0: whole if they fit, else cut at the capacity.

    Null texts count as empty: one piece of one id. ``path`` is the tokenizer's file.
    """
    path = path or tokenizer_path()
    end, step = np.array([END_ID], "<u4").tobytes(), 4 * capacity

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                small = batch.slice(lo, BATCH_ROWS)
                rows = []
                for doc, text in zip(small.column(0).to_pylist(), small.column(1).to_pylist(), strict=True):
                    ids = token_bytes(text or "", path) + end
                    rows += [(doc, k, at // 4, len(ids[at : at + step]) // 4, zlib.crc32(ids[at : at + step])) for k, at in enumerate(range(0, len(ids), step))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- the plan


@dataclass
class Step:
    """``each`` pieces of ``length`` in each of ``bins`` sequences from ``sequence`` on, from ``offset`` on;
    they are the ranks from ``rank`` on of that length."""

    length: int
    rank: int
    bins: int
    each: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Step], int]:
    """Steps that place every piece, and the number of sequences."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("every length must be between 1 and the capacity")
    ranks, steps, opened = dict.fromkeys(left, 0), [], 0
    gaps: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, bins)

    def place(length, bins, each, sequence, used):
        steps.append(Step(length, ranks[length], bins, each, sequence, used))
        ranks[length] += bins * each
        left[length] -= bins * each

    def keep(gap, sequence, bins):
        if gap and bins:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((sequence, bins))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            fits = [m for m in large[: bisect_left(large, min(n, capacity - n) + 1)] if left[m] > (m == n)]
            mate = fits[-1] if fits else None
            if mate is None:
                bins, gap = left[n], capacity - n
                place(n, bins, 1, opened, 0)
            elif mate == n:
                bins, gap = left[n] // 2, capacity - 2 * n
                place(n, bins, 2, opened, 0)
            else:
                bins, gap = min(left[n], left[mate]), capacity - n - mate
                place(n, bins, 1, opened, 0)
                place(mate, bins, 1, opened, n)
            keep(gap, opened, bins)
            opened += bins
    for n in sorted((m for m in left if 3 * m <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                gap, sequence, bins = capacity, opened, max(1, left[n] // (capacity // n))
                opened += bins
            else:
                gap = gaps[at]
                sequence, bins = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap], gaps[at]
            each = min(gap // n, left[n])
            taken = min(bins, left[n] // each)
            place(n, taken, each, sequence, capacity - gap)
            keep(gap - each * n, sequence, taken)
            keep(gap, sequence + taken, bins - taken)
    return steps, opened


# ---------------------------------------------------------------- assignment


def ranked(pieces: DataFrame, salts: int | None = None) -> DataFrame:
    """Adds ``rank`` from 0 among the pieces of equal length: offsets of salted sub-groups plus the place inside.

    Pieces are shuffled once, by length and salt; the offsets, a row a sub-group, meet them where they then are.
    """
    salts = salts or max(16, shuffle_partitions(pieces.sparkSession))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("_k", F.row_number().over(inside) - 1).join(starts, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_k")).drop("_salt", "_before", "_k")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32). An empty table stays empty."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    steps, _ = plan(histogram, capacity)
    steps.sort(key=lambda s: (s.length, s.rank))
    shift = 1 << 44
    table = np.array([(s.length * shift + s.rank, s.each, s.sequence, s.offset) for s in steps], np.int64).reshape(-1, 4)
    shared = pieces.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        t = shared.value
        for batch in batches:
            cols = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            length, rank = (cols[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(t[:, 0], length * shift + rank, side="right") - 1
            step = t[at]
            k = rank - (step[:, 0] - length * shift)
            out = [cols[c] for c in PIECES.names] + [pa.array(step[:, 2] + k // step[:, 1]), pa.array(step[:, 3] + k % step[:, 1] * length)]
            yield pa.RecordBatch.from_arrays(out, names=[*PIECES.names, "sequence_id", "offset"])

    return map_arrow(ranked(pieces).select(*PIECES.names, "rank"), run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence; awkward rows as in ``pack_stage``."""
    return pack_stage(spark, read_table(spark, sf_dir, "documents"), sf_dir)


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: pieces of all documents with their place in a sequence.

    Null and empty texts are a piece of one id. Texts of any length are tokenised whole and cut into pieces; rows that
    repeat have pieces each; pieces of equal length are told apart by rank, so ties don't matter. Null ids and
    other columns don't matter either. An empty table stays empty.
    """
    return pack(materialize(tokenize_pieces(docs), "op4-pieces"))
