"""Shared pieces of the corpus operators: scratch tables and vectorised text kernels.

The kernels work on Arrow buffers. A batch of texts is cut into slices of about half a
megabyte (a longer text forms a slice of its own), so memory follows the longest
text and never the number of rows in a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import discard, materialize, shared_dir  # noqa: F401

U64 = np.uint64
SLICE_BYTES = 1 << 19

#: The separators of the contracts, space and U+0009 to U+000D.
SEPARATORS = b" \t\n\x0b\x0c\r"
SEPARATOR_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[ord("A") : ord("Z") + 1] += 32


# ---------------------------------------------------------------- scratch tables


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_bucket(key: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``: the fold of a row."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


ROW = ("id_key", "no_id", "text_key")
ROW_SQL = "id_key long, no_id boolean, text_key long"


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ROW, keys without nulls that are equal for rows alike in doc_id and text."""
    return docs.withColumns({"id_key": F.coalesce(F.col("doc_id"), F.lit(0)).cast("long"), "no_id": F.col("doc_id").isNull(), "text_key": F.xxhash64(F.coalesce("text", F.lit("")))})


# ---------------------------------------------------------------- text buffers


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow text column, without a copy of the bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int32 if pa.types.is_string(column.type) else np.int64
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows of about ``limit`` bytes."""
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), rows)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def pieces(text: bytes, limit: int = 2 * SLICE_BYTES) -> Iterator[bytes]:
    """A text in pieces of ``limit`` bytes or a little more, cut at separators only."""
    at = 0
    while len(text) - at > limit:
        cut = at + limit
        while cut < len(text) and text[cut] not in SEPARATORS:
            cut += 1
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:] if at else text


# ---------------------------------------------------------------- hashing

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2**64, and their inverses; tables of up to two slices' length are kept."""
    for kept in (SLICE_BYTES + 2, 2 * SLICE_BYTES + 2):
        if n <= kept:
            if len(_powers[0]) < n:
                _powers[:] = _power_tables(kept)
            return _powers[0][:n], _powers[1][:n]
    return _power_tables(n)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        step = np.full(n, base, U64)
        step[0] = 1
        out.append(np.multiply.accumulate(step))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (SplitMix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes modulo 2**64: entry i covers data[:i]. They deal strings out; nothing is equal by them alone."""
    out = np.zeros(len(data) + 1, U64)
    if len(data):
        np.cumsum((data.astype(U64) + U64(1)) * powers(len(data))[0], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they lie."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


PRIME = (1 << 61) - 1
_PRIME_BASE = 0x1B7E9A5D3C84F061 % PRIME
_low30, _low31, _prime = U64((1 << 30) - 1), U64((1 << 31) - 1), U64(PRIME)
_prime_powers = [np.ones(1, U64)]


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x >> U64(61)) + (x & _prime)
    return np.where(x >= _prime, x - _prime, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1, by halves."""
    a1, a0, b1, b0 = a >> U64(31), a & _low31, b >> U64(31), b & _low31
    mid = a0 * b1 + a1 * b0
    return _reduced(U64(2) * a1 * b1 + (mid >> U64(30)) + ((mid & _low30) << U64(31)) + a0 * b0)


def prime_powers(n: int) -> np.ndarray:
    """The first n powers of the seeded base modulo 2**61 - 1."""
    got = _prime_powers[0]
    while len(got) < n:
        step = times(got[-1:], np.array([_PRIME_BASE], U64))
        got = np.concatenate([got, times(got, step)])
    _prime_powers[0] = got
    return got[:n]


def prime_prefixes(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes modulo 2**61 - 1 of up to 2**22 bytes: entry i covers data[:i]."""
    power, code = prime_powers(len(data)), data.astype(U64) + U64(1)
    low, high = np.cumsum((power & _low31) * code, dtype=U64), np.cumsum((power >> U64(31)) * code, dtype=U64)
    return np.concatenate([np.zeros(1, U64), _reduced(_reduced(low) + ((high & _low30) << U64(31)) + (high >> U64(30)))])


# ---------------------------------------------------------------- skew and memory


def map_arrow(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow whose workers give freed memory back when a task ends; an idle worker would keep it."""

    def task(batches):
        yield from run(batches)
        give_back()

    return rows.mapInArrow(task, schema)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def hot_keys(rows: DataFrame, keys: list[str], total: int, per_row: int = 1, share: int = 1000) -> DataFrame:
    """The keys that hold at least one in ``share`` of ``total`` input rows; ``rows`` has ``per_row`` rows of each at most.

    Each such key takes total / share of total * per_row rows, so there are share * per_row of them at
    most: a table that may be broadcast at any input size.
    """
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * share >= max(total, share)).drop("_n")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, whose keys are unique. Rows of the few ``hot`` keys meet their entry by
    broadcast, where they lie; all others are shuffled, so no task gets the rows of a frequent key."""
    hot = F.broadcast(hot)
    there = rows.join(F.broadcast(table.join(hot, keys, "left_semi")), keys)
    return there.unionByName(rows.join(hot, keys, "left_anti").join(table.join(hot, keys, "left_anti"), keys, how))


#: Bits of the filter of ``may_hold``, 64 a row: the table that is broadcast has 2**18 rows at any input size.
FILTER_BITS = 1 << 24


def may_hold(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The ``rows`` whose ROW has the hash of one in ``table``, so all that join with it and few others: texts that join
    with nothing are not shuffled."""
    at = F.pmod(F.xxhash64(*ROW), F.lit(FILTER_BITS))
    own = {"_word": F.shiftright(at, 6), "_bit": F.expr(f"shiftleft(1L, CAST(pmod(xxhash64({', '.join(ROW)}), {FILTER_BITS}) % 64 AS INT))")}
    marks = table.select(*(c.alias(n) for n, c in own.items())).groupBy("_word").agg(F.bit_or("_bit").alias("_mask"))
    there = F.broadcast(marks).withColumnRenamed("_word", "_at")
    return rows.withColumns(own).join(there, (F.col("_word") == F.col("_at")) & (F.col("_mask").bitwiseAND(F.col("_bit")) != 0), "left_semi").drop(*own)


# ---------------------------------------------------------------- words and shingles


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 1, bool)
    np.logical_not(IS_SEPARATOR[data], out=inside[:n])
    before = np.zeros(n, bool)
    before[1:] = inside[: n - 1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[firsts] = False
    starts = np.flatnonzero(inside[:n] & ~before)
    after = inside[1:].copy()
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    ends = np.flatnonzero(inside[:n] & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Polynomial hashes modulo 2**64 are sound for short strings only; longer words are hashed by xxh3.
LONG_WORD = 256


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = ASCII_LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    codes = mix(range_hashes(prefix_hashes(data), starts, ends) + (ends - starts).astype(U64))
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        codes[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), 20)
    return codes, first


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, lower-cased in A to Z, and for each row the index of its first word.

    A text longer than a slice is taken in pieces that end at a separator.
    """
    if len(data) <= 2 * SLICE_BYTES:
        return _codes(data, offsets)
    parts, first = [], [0]
    for at, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        count = 0
        while at < stop:
            end = min(at + SLICE_BYTES, stop)
            while end < stop and not len(gap := np.flatnonzero(IS_SEPARATOR[data[end : end + 65536]])):
                end = min(end + 65536, stop)
            end = end + int(gap[0]) if end < stop else stop
            parts.append(_codes(data[at:end], np.array([0, end - at]))[0])
            count, at = count + len(parts[-1]), end
        first.append(first[-1] + count)
    return np.concatenate([np.zeros(0, U64), *parts]), np.array(first)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its word shingles.

    Words are lower-cased in A to Z. A row of fewer than ``size`` words has one shingle,
    the whole sequence; a row without words has none.
    """
    weights = mix(np.arange(1, size + 1, dtype=U64)) | U64(1)
    codes, first = word_codes(data, offsets)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        words = codes[a:b]
        n = b - a
        if n >= size:
            grams = words[: n - size + 1] * weights[0]
            for j in range(1, size):
                grams += words[j : n - size + 1 + j] * weights[j]
            yield np.unique(mix(grams))
        elif n:
            yield mix((words * weights[:n]).sum(keepdims=True, dtype=U64) + U64(n))
        else:
            yield np.zeros(0, U64)
