"""Filter interaction audit on sorted posting lists.

For every part and range of ids there is a list of failing ids per filter, and lists of the good and
the toxic ids. Unions of lists are made by galloping k-way merges, differences likewise; their sizes
are summed over ranges. From the sizes of the unions of all sets of filters follows, for any order of
the filters, what each step removes.

Lists are cut at ``BLOCK_ROWS`` rows, so no list grows with the table; ids are numbered within
their block in ascending doc_id order, which keeps rows apart that share an id.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from heapq import heapify, heappop, heapreplace
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, map_arrow, materialize, pieces, read_table, shuffle_partitions, text_buffers

FILTERS = "ABCDE"
BLOCK_ROWS = 1 << 15

# ---------------------------------------------------------------- galloping merges


def gallop(ids: list[int], value: int, lo: int) -> int:
    """First place from ``lo`` on whose id is ``value`` or more: doubling steps, then bisection."""
    step, hi, n = 1, lo, len(ids)
    while hi < n and ids[hi] < value:
        lo = hi + 1
        hi += step
        step *= 2
    return bisect_left(ids, value, lo, min(hi, n))


def union(lists: list[list[int]]) -> list[int]:
    """K-way merge of ascending lists, each id once: the list of the least head gives all ids before the next head at a time."""
    heads = [(ids[0], k) for k, ids in enumerate(lists) if ids]
    at, out = [0] * len(lists), []
    heapify(heads)
    while len(heads) > 1:
        k = heads[0][1]
        ids = lists[k]
        nxt = min(heads[1], heads[2])[0] if len(heads) > 2 else heads[1][0]
        end = gallop(ids, nxt, at[k])
        out += ids[at[k] : end]
        end += end < len(ids) and ids[end] == nxt  # the other list gives that one
        at[k] = end
        if end < len(ids):
            heapreplace(heads, (ids[end], k))
        else:
            heappop(heads)
    for _, k in heads:
        out += lists[k][at[k] :]
    return out


def difference(a: list[int], b: list[int]) -> list[int]:
    """Ids of ``a`` that are not in ``b``; both ascend."""
    i = j = 0
    out: list[int] = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            end = gallop(a, b[j], i)
            out += a[i:end]
            i = end
        else:
            j = gallop(b, a[i], j)
    return out + a[i:]


# ---------------------------------------------------------------- lists and sizes


def posting_lists(rows: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """(part, first_id, last_id, n, and an ascending array a filter and a mark) from rows (part, doc_id, row, booleans).

    ``rows`` is a written table, and ``row`` tells rows of one doc_id apart: ranges of both are dealt out, so neither a large part
    nor a frequent id meets in one task.
    """
    names = [*filters, *marks]
    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "doc_id", "row").sortWithinPartitions("part", "doc_id", "row")

    def run(batches):
        for batch in batches:
            part = batch.column(0).to_pylist()
            cuts = [0, *(k for k in range(1, len(part)) if part[k] != part[k - 1]), len(part)]
            cuts = [at for a, b in zip(cuts, cuts[1:], strict=False) for at in range(a, b, BLOCK_ROWS)] + [len(part)]
            flags = [c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]
            blocks = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
            lists = [pa.array([np.flatnonzero(f[a:b]).astype(np.int32) for a, b in blocks], pa.list_(pa.int32())) for f in flags]
            first = [batch.column(1).take(pa.array([x[k] - k for x in blocks], pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([part[a] for a, _ in blocks], pa.string()), *first, pa.array([b - a for a, b in blocks], pa.int64()), *lists], names=["part", "first_id", "last_id", "n", *names])

    schema = "part string, first_id long, last_id long, n long, " + ", ".join(f"{n} array<int>" for n in names)
    return map_arrow(ranged.select("part", "doc_id", *(F.coalesce(n, F.lit(False)).alias(n) for n in names)), run, schema)


def union_sizes(postings: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """(part, subset, failing, a count per mark): documents that fail any filter of the set whose bits are ``subset``.

    Subset 0 has no failing one; its column ``n`` counts the part's documents.
    """

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, n, *lists = (c[k].as_py() for c in batch.columns)
                own, marked = lists[: len(filters)], lists[len(filters) :]
                rows = []
                for subset in range(1 << len(filters)):
                    failing = union([ids for f, ids in enumerate(own) if subset >> f & 1])
                    rows.append((part, subset, n, len(failing), *(len(failing) - len(difference(failing, ids)) for ids in marked)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *(pa.int64() for _ in marks)]
    names = ["part", "subset", "n", "failing", *marks]
    schema = "part string, subset int, n long, failing long, " + ", ".join(f"{m} long" for m in marks)
    counted = map_arrow(postings.select("part", "n", *filters, *marks), run, schema)
    return counted.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in names[2:]))


def steps(sizes: DataFrame, filters: str) -> DataFrame:
    """A row per part, order of the filters and step, from ``union_sizes`` with marks good and toxic."""
    full = (1 << len(filters)) - 1
    table = sizes.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", F.struct("n", "failing", "good", "toxic")))).alias("u"))
    plan = []
    for order in permutations(filters):
        before = 0
        for k, letter in enumerate(order, 1):
            plan.append(f"('{''.join(order)}', {k}, '{letter}', {1 << filters.index(letter)}, {before})")
            before |= 1 << filters.index(letter)
    # The orders are fixed; each part takes all of them.
    rows = table.selectExpr("part", "u", f"inline(from_json('{_json(plan)}', 'array<struct<filter_order: string, step: int, letter: string, bit: int, before: int>>'))")

    def of(subset: Column, name: str) -> Column:
        return F.col("u")[subset][name]

    bit, before = F.col("bit"), F.col("before")
    now = before.bitwiseOR(bit)
    rows = rows.withColumn("removed", of(now, "failing") - of(before, "failing"))
    every = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        (of(F.lit(0), "n") - of(now, "failing")).alias("kept"),
        "removed",
        (of(bit, "failing") - F.col("removed")).alias("redundant"),
        (of(F.lit(full), "failing") - of(F.lit(full) - bit, "failing")).alias("unique_fails"),
        (of(now, "good") - of(before, "good")).alias("good_lost"),
        (of(now, "toxic") - of(before, "toxic")).alias("toxic_lost"),
        every.alias("shapley"),
    )


def _json(plan: list[str]) -> str:
    keys = ("filter_order", "step", "letter", "bit", "before")
    return "[" + ",".join("{" + ",".join(f'"{k}":{v.strip()}' for k, v in zip(keys, p.strip("()").replace("'", '"').split(","), strict=True)) + "}" for p in plan) + "]"


# ---------------------------------------------------------------- the five filters

_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_INNER = bytes(range(0x80, 0xC0))  # bytes that continue a character
_MARKS = b"#$%&*|"


def measure(text: bytes) -> tuple[bool, bool, bool, bool, bytes]:
    """Whether a text fails A, B, C and D, and its digest. The words of a long text are counted in pieces."""
    words, distinct = 0, set()
    for piece in pieces(text):
        found = piece.split()  # at the contract's separators, for bytes
        words += len(found)
        distinct.update(found)
    upper, points = len(text.translate(None, _NOT_UPPER)), len(text.translate(None, _INNER))
    return words < 100, 100 * len(distinct) < 80 * words, 100 * upper > 10 * points, len(text.translate(None, _MARKS)) < len(text), hashlib.sha256(text).digest()


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, digest): filters of the text alone."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            found = [measure(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in zip(*found, strict=True))], names=["doc_id", "part", *"ABCD", "digest"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), "text"), run, "doc_id long, part string, A boolean, B boolean, C boolean, D boolean, digest binary")


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, doc_id, row, A to E, good, toxic), a written table.

    E needs the whole table: the least doc_id of each text that occurs twice or more meets its copies where they lie if
    they are many, and by a shuffle of digests else.
    """
    rows = materialize(measured(docs).withColumn("row", F.monotonically_increasing_id()), "op12-measured")
    total = rows.count()
    first = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "op12-copies")
    hot = first.where(F.col("copies") * 1000 >= total).select("digest")  # 1,000 at most
    rows = lookup(rows, first.select("digest", "least"), ["digest"], hot, "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("digest", "least")
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return materialize(rows.join(marked, "doc_id", "left"), "op12-filtered")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each of their 120 orders, per language.

    Null texts are empty and fail A, and E where a smaller id's text is empty too. A row without a doc_id never fails E, no row fails E by it,
    and it has no labels; rows of one doc_id count each, and don't fail E by each other. A doc_id with several labels
    is good or toxic if one of them says so. Long texts are taken whole; other columns don't matter. An empty table gives no part.
    """
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    rows = filtered(docs.select("doc_id", "lang", "text"), labels)
    filters, marks = list(FILTERS), ["good", "toxic"]
    return steps(union_sizes(posting_lists(rows, filters, marks), filters, marks), FILTERS)


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marked AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM words LEFT JOIN marked USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.b + b.b + c.b + d.b + e.b = 31
    AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
places AS (
  SELECT filter_order, s AS step, bits[s] AS bit, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INTEGER) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
steps AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n_good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM counts, places GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM steps
"""
