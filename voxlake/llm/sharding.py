"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot is a hash of its doc_id modulo ``SLOTS`` and never changes. Which shard holds a
slot says the map, a table of edits (version, slot, shard): a slot lies where its latest edit up
to a version puts it. Rebalancing looks at the bytes a slot holds, moves few slots and
appends their edits; a new shard takes slots from the others and nothing else moves.

A doc_id that many rows share (null is one) would make a slot that no map can balance: the rows of
such hot ids are spread over the slots by a row number. Loads and maps are tables of
``SLOTS`` rows, whatever the input; they alone reach the driver.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scratch import scratch_path
from .common import materialize, read_table

SLOTS = 4096
SHARDS = 24


# ---------------------------------------------------------------- records and slots


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, row): UTF-8 bytes plus 8, and the text's checksum. Null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))


def with_slots(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds virtual_slot to a written table with doc_id and row. An id of one row in a thousand or more (1,000 ids at most) is spread."""
    key = F.xxhash64("doc_id")
    total = records.count()
    often = records.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) & (F.col("_n") * 1000 >= total))
    rows = records.withColumn("_key", key).join(F.broadcast(often), "_key", "left")
    spread = F.when(F.col("_n").isNotNull(), F.xxhash64("_key", "row")).otherwise(F.col("_key"))
    return rows.withColumn("virtual_slot", F.pmod(spread, F.lit(slots)).cast("int")).drop("_key", "_n")


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Bytes and rows of every slot, summed where the rows lie."""
    out = np.zeros((slots, 2), np.int64)
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect():
        out[r["virtual_slot"]] = r["bytes"], r["n"]
    return out


# ---------------------------------------------------------------- the map


@dataclass(frozen=True)
class SlotMap:
    """The shard of every slot at a version."""

    version: int
    shards: int
    owner: np.ndarray

    @staticmethod
    def first(shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        """Version 1: equal ranges of slots."""
        return SlotMap(1, shards, np.arange(slots, dtype=np.int64) * shards // slots)

    def fill(self, load: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, load, self.shards).astype(np.int64)

    def rebalanced(self, load: np.ndarray) -> SlotMap:
        """The next version, of near equal sums of ``load``.

        A shard keeps its slots, the heaviest first, up to an equal share; the rest go, the heaviest first, to
        the shard that holds least. Then the fullest and the emptiest shard give and swap slots while that brings them closer.
        """
        owner, fill, loose = self.owner.copy(), [0] * self.shards, []
        share = int(load.sum()) / self.shards
        for s in np.argsort(-load, kind="stable").tolist():
            at, n = int(owner[s]), int(load[s])
            if fill[at] == 0 or fill[at] + n <= share:
                fill[at] += n
            else:
                loose.append(s)
        heap = [(n, k) for k, n in enumerate(fill)]
        heapq.heapify(heap)
        for s in loose:
            n, k = heap[0]
            owner[s] = k
            heapq.heapreplace(heap, (n + int(load[s]), k))
        return SlotMap(self.version + 1, self.shards, _levelled(owner, load, self.shards))

    def grown(self, load: np.ndarray) -> SlotMap:
        """The next version with one more shard, which takes slots from the fullest until it holds an equal share."""
        owner, new = self.owner.copy(), self.shards
        fill, share, taken = self.fill(load), int(load.sum()) / (new + 1), 0
        for s in np.argsort(-load, kind="stable").tolist():
            n, at = int(load[s]), int(owner[s])
            if n and taken + n <= share and fill[at] - n >= share * 0.98:
                owner[s], taken = new, taken + n
                fill[at] -= n
        return SlotMap(self.version + 1, new + 1, owner)


def _levelled(owner: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    fill = np.bincount(owner, load, shards).astype(np.int64)
    for _ in range(4 * len(load)):
        full, light = int(fill.argmax()), int(fill.argmin())
        gap = int(fill[full] - fill[light])
        mine, theirs = np.flatnonzero(owner == full), np.flatnonzero(owner == light)
        theirs = theirs[np.argsort(load[theirs], kind="stable")]
        # What each own slot is best swapped for: nothing, or the slot that leaves nearest to half the gap.
        other = np.concatenate([[0], load[theirs]])
        at = np.searchsorted(other, load[mine] - gap / 2).clip(1, len(other) - 1) if len(theirs) else np.zeros(len(mine), np.int64)
        for k in (at, at - (at > 0), np.zeros(len(mine), np.int64)):
            moved = load[mine] - other[k]
            good = np.flatnonzero((moved > 0) & (moved < gap))
            if len(good):
                best = good[np.abs(moved[good] - gap / 2).argmin()]
                owner[mine[best]] = light
                if k[best]:
                    owner[theirs[k[best] - 1]] = full
                fill[full] -= moved[best]
                fill[light] += moved[best]
                break
        else:
            break
    return owner


def append_edits(spark: SparkSession, path: str, new: SlotMap, old: SlotMap | None = None) -> None:
    """Appends what ``new`` changes (all of it without ``old``) to the table of edits at ``path``."""
    changed = np.arange(len(new.owner)) if old is None else np.flatnonzero(new.owner != old.owner)
    rows = [(new.version, new.shards, int(s), int(new.owner[s])) for s in changed] or [(new.version, new.shards, 0, int(new.owner[0]))]
    spark.createDataFrame(rows, "version int, shards int, slot int, shard int").coalesce(1).write.mode("append").parquet(path)


def map_at(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(virtual_slot, shard) as of ``version``."""
    edits = spark.read.parquet(path).where(F.col("version") <= version)
    return edits.groupBy(F.col("slot").alias("virtual_slot")).agg(F.max_by("shard", "version").alias("shard"))


# ---------------------------------------------------------------- placing


def place(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """Adds shard and slot (the place in the shard, gapless from 0) to rows with virtual_slot.

    Rows are numbered within their virtual slot, so a shard's rows are dealt over many tasks; a slot
    starts where the slots of lower number in its shard end. Both tables of slots are bounded broadcasts.
    """
    counts = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(mapped), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("virtual_slot", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "row")
    numbered = rows.withColumn("_k", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("_start") + F.col("_k")).drop("_start", "_k")


def shard(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, virtual_slot, map_version) of documents; the map is kept at ``path``.

    Null texts count as empty; rows without a doc_id, and rows that repeat, are records of their own. Texts of any
    length are measured whole; a record larger than an equal share fills its shard alone. Other columns don't
    matter. An empty table stays empty.
    """
    spark = docs.sparkSession
    rows = materialize(with_slots(materialize(sized(docs), "records"), slots), "slots")
    load = slot_loads(rows, slots)[:, 0]
    start = SlotMap.first(shards, slots)
    level = start.rebalanced(load)
    append_edits(spark, path, start)
    append_edits(spark, path, level, start)
    placed = place(rows, map_at(spark, path, level.version))
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot", F.lit(level.version).alias("map_version"))


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes; awkward rows as in ``shard``."""
    out = shard(read_table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "slot-map"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
