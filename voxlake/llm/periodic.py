"""Periodic runs of words: longest common extensions from a difference cover, driven by a harmonic grid.

A run of period p and four periods or more holds four neighbouring multiples of p, which carry the
same word. So for every p the words at multiples of p are compared (n / p of them, n log n in all),
and where four in a row agree the run's ends follow from two longest common extensions (LCE).

An LCE is found with the suffixes at sampled positions alone. The samples are the positions
whose remainder modulo V lies in a difference cover: for any two positions there is a shift below V
that takes both to samples, so a few words are compared and then two sorted samples, whose common
prefix is a range minimum over the neighbours' common prefixes (a sparse table). Backward
extensions are forward ones of the reversed words.

Texts are taken in slices, each document closed by a word of its own, so nothing matches across documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, map_arrow, pieces, read_table

LEAST_WORDS, LEAST_PERIODS = 6, 4

#: A perfect difference set modulo 21; every remainder is a difference of two of its members.
V, COVER = 21, (3, 6, 7, 12, 14)


def _shifts() -> np.ndarray:
    """For two remainders the least shift that takes both into the cover."""
    inside = np.zeros(2 * V, bool)
    inside[[c + k for c in COVER for k in (0, V)]] = True
    out = np.full((V, V), -1)
    for a in range(V):
        for b in range(V):
            out[a, b] = next(d for d in range(V) if inside[a + d] and inside[b + d])
    return out


SHIFT = _shifts()


class Extensions:
    """LCEs of positions of ``words``, positive integers of which the last occurs nowhere else."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate([words, np.zeros(V, words.dtype)])
        starts = [np.arange(c, n, V) for c in COVER]
        at = np.concatenate(starts)
        self.base = np.zeros(V, np.int64)
        self.base[list(COVER)] = np.cumsum([0, *map(len, starts)])[:-1]
        blocks = sliding_window_view(self.words, V)
        # Blocks of V words as big-endian bytes compare like the words; each class of samples ends in a block of its own.
        rows = np.ascontiguousarray(blocks[at].astype(">u4")).view(f"S{4 * V}").ravel()
        names = np.unique(rows, return_inverse=True)[1] + 1
        del rows
        m = len(at)
        levels = [np.append(names, 0).astype(np.int64)]
        while m and levels[-1].max() < m:
            last, step = levels[-1], 1 << (len(levels) - 1)
            after = np.zeros(m, np.int64)
            after[: max(m - step, 0)] = last[step:m]
            levels.append(np.append(np.unique(last[:m] * (m + 1) + after, return_inverse=True)[1] + 1, 0))
        self.rank = levels[-1][:m] - 1
        order = np.empty(m, np.int64)
        order[self.rank] = np.arange(m)
        a, b, off = order[:-1], order[1:], np.zeros(max(m - 1, 0), np.int64)
        for k in reversed(range(len(levels))):
            same = levels[k][np.minimum(a + off, m)] == levels[k][np.minimum(b + off, m)]
            off += same.astype(np.int64) << k
        inner = np.zeros(len(off), np.int64)
        for lo in range(0, len(off), 1 << 15):
            s = slice(lo, lo + (1 << 15))
            inner[s] = (blocks[at[a[s] + off[s]]] != blocks[at[b[s] + off[s]]]).argmax(1)
        table = [(V * off + inner).astype(np.int32)]
        while 2 << (len(table) - 1) <= len(off):
            step, low = 1 << (len(table) - 1), table[-1]
            table.append(np.append(np.minimum(low[:-step], low[step:]), low[len(low) - step :]))
        self.table = np.array(table)

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on agree, for each pair of different positions."""
        w, out = self.words, np.zeros(len(i), np.int64)
        shift = SHIFT[i % V, j % V]
        live, t = np.arange(len(i)), 0
        done = []
        while len(live):
            arrived = shift[live] == t
            done.append(live[arrived])
            live = live[~arrived]
            live = live[w[i[live] + t] == w[j[live] + t]]
            t += 1
            out[live] = t
        done = np.concatenate(done) if done else live
        a, b = i[done] + shift[done], j[done] + shift[done]
        a, b = self.rank[self.base[a % V] + a // V], self.rank[self.base[b % V] + b // V]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out[done] = shift[done] + np.minimum(self.table[k, lo], self.table[k, hi - (1 << k)])
        return out


def grid(words: np.ndarray, longest: int, batch: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, periods) where four neighbouring multiples of a period carry the same word, periods ascending, about ``batch`` at a time."""
    found, size = [], 0
    for p in range(1, longest // LEAST_PERIODS + 1):
        g = words[::p]
        same = g[:-1] == g[1:]
        k = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(k):
            found.append((k * p, np.full(len(k), p)))
            size += len(k)
        if size >= batch:
            yield tuple(map(np.concatenate, zip(*found, strict=True)))
            found, size = [], 0
    if found:
        yield tuple(map(np.concatenate, zip(*found, strict=True)))


def runs(words: np.ndarray, longest: int) -> np.ndarray:
    """(start, length, period) of all runs, by start, then period.

    ``words`` begins and ends with words that occur once, and so may close documents of at most ``longest`` words in between.
    """
    n = len(words)
    forward = backward = None
    out = [np.zeros((0, 3), np.int64)]
    for i, p in grid(words, longest):
        if forward is None:
            forward, backward = Extensions(words), Extensions(words[::-1])
        ahead, back = forward.lce(i, i + p), backward.lce(n - i, n - i - p)
        rows = np.stack([i - back, back + p + ahead, p], 1)
        rows = rows[rows[:, 1] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)]
        out.append(_least_periods(rows))
    rows = _least_periods(np.concatenate(out))
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _least_periods(rows: np.ndarray) -> np.ndarray:
    """One row for each stretch: a stretch that multiples of its period have found too keeps the smallest."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[new]


class _Numbers(dict):
    """Words numbered from 1 as they come."""

    def __missing__(self, word):
        self[word] = n = len(self) + 1
        return n


def numbered(text: bytes, numbers: _Numbers) -> np.ndarray:
    parts = [np.fromiter(map(numbers.__getitem__, piece.split()), np.int32) for piece in pieces(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def slice_runs(docs: list[np.ndarray], closing: int) -> list[np.ndarray]:
    """Runs of each document of numbered words; numbers from ``closing`` on are free. Only documents that the grid finds candidates in are indexed."""
    out = [np.zeros((0, 3), np.int64)] * len(docs)

    def joined(some):
        parts = [np.array([closing], np.int32)]
        for k, d in enumerate(some, 1):
            parts += [d, np.array([closing + k], np.int32)]
        return np.concatenate(parts), 1 + np.cumsum([0, *(len(d) + 1 for d in some)])

    words, at = joined(docs)
    hit = np.zeros(len(docs), bool)
    for i, _ in grid(words, max(map(len, docs), default=0)):
        hit[np.searchsorted(at, i, side="right") - 1] = True
    chosen = np.flatnonzero(hit)
    if not len(chosen):
        return out
    some = [docs[k] for k in chosen]
    words, at = joined(some)
    rows = runs(words, max(map(len, some)))
    owner = np.searchsorted(at, rows[:, 0], side="right") - 1
    rows[:, 0] -= at[owner]
    bounds = np.searchsorted(owner, np.arange(len(some) + 1))
    for k, doc in enumerate(chosen):
        out[doc] = rows[bounds[k] : bounds[k + 1]]
    return out


def dropped(n: int, rows: np.ndarray) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edge, rows[:, 0] + rows[:, 1], -1)
    return edge.cumsum()[:n] > 0


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
OUT_SQL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def find_runs(docs: DataFrame, rewrite: Callable[[int, int], np.ndarray | None] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of documents (doc_id, text): all runs by start and period, and the words without repeated periods.

    ``rewrite(doc_id, n)`` may give word numbers to read in place of 0 to n - 1. Null texts, empty ones and texts without a word have
    no runs and an empty ``collapsed``. Long texts are taken whole (a text longer than a slice is a slice). Null
    ids, rows that repeat and other columns don't matter; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for k in range(batch.num_rows):
                text = (batch.column(1)[k].as_py() or "").encode()
                if held and size + len(text) > SLICE_BYTES:
                    yield emit(held)
                    held, size = [], 0
                held.append((batch.column(0)[k].as_py(), text))
                size += len(text)
            if held:
                yield emit(held)

    def emit(held):
        numbers = _Numbers()
        docs = []
        for doc, text in held:
            words = numbered(text, numbers)
            if rewrite is not None and len(words) and (index := rewrite(doc, len(words))) is not None:
                words = words[index]
            docs.append(words)
        names = list(numbers)
        found = slice_runs(docs, len(names) + 1)
        shown, count = [], np.cumsum([0, *map(len, found)])
        for words, rows in zip(docs, found, strict=True):
            kept = words[~dropped(len(words), rows)] if len(rows) else words
            shown.append(b" ".join([names[k] for k in (kept - 1).tolist()]).decode())
        rows = np.concatenate(found)
        structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], names=["start", "length", "period"])
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.int64()), pa.array(list(map(len, docs)), pa.int64()), pa.ListArray.from_arrays(pa.array(count, pa.int32()), structs), pa.array(shown, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, OUT_SQL)


def repeats_planted(doc: int | None, n: int) -> np.ndarray | None:
    """The contract's edit: in a tenth of the documents the words from a place on repeat with a period."""
    import zlib

    if doc is None:
        return None
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    index = np.arange(n)
    index[a:] = a + (index[a:] - a) % p
    return index


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document's words, after the contract's edit, and what is left without repeats.

    A null doc_id has no edit; other awkward rows as in ``find_runs``.
    """
    found = find_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text"), repeats_planted)
    nothing = F.lit(None).cast("struct<start: long, length: long, period: long>")
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", nothing, lambda b, r: F.when(more(b, r), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length DIV best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
