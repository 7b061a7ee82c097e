"""Serving blocks to an access log, as joins of tables: requests (seq, lod, bz, by, bx), resident blocks, a catalog with states.

What a cache or a fetch queue keeps in memory elsewhere is a table here: which blocks are resident is a set, what to
fetch is a difference of sets, and a tick of a frozen cache is a group of requests that all see the same set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import ABSENT, PRESENT, block_box
from ..functions.order import running

BLOCK = ["lod", "bz", "by", "bx"]


def contains(wanted: DataFrame, resident: DataFrame) -> DataFrame:
    """``wanted`` with whether each block is resident."""
    have = resident.select(*BLOCK).distinct().withColumn("resident", F.lit(True))
    return wanted.join(have, BLOCK, "left").withColumn("resident", F.coalesce("resident", F.lit(False)))


def within_budget(log: DataFrame, sizes: DataFrame, capacity: int) -> DataFrame:
    """(block, last_seq, used): the most recently used blocks whose sizes (block, n_bytes) add up to ``capacity`` at most."""
    last = log.groupBy(*BLOCK).agg(F.max("seq").alias("last_seq")).join(sizes, BLOCK)
    used = running(last, [F.desc("last_seq"), *map(F.col, BLOCK)], F.col("n_bytes"), "used")
    return used.where(F.col("used") <= capacity).select(*BLOCK, "last_seq", "used")


def to_prefetch(catalog: DataFrame, resident: DataFrame, wanted: Column) -> DataFrame:
    """Blocks of the catalog that hold material, are ``wanted`` (a predicate of a chunk, a region, a level) and aren't resident."""
    return catalog.where((F.col("state") == PRESENT) & wanted).select(*BLOCK).join(resident, BLOCK, "left_anti")


def in_chunk(cz: int, cy: int, cx: int, per: int, lod: int = 0) -> Column:
    """Blocks of a chunk that is ``per`` blocks wide."""
    return (F.col("lod") == lod) & F.col("bz").between(cz * per, cz * per + per - 1) & F.col("by").between(cy * per, cy * per + per - 1) & F.col("bx").between(cx * per, cx * per + per - 1)


def in_region(box: tuple[int, int, int, int, int, int], edge: int, lod: int = 0) -> Column:
    """Blocks of ``edge`` voxels that a box of voxels touches."""
    return (F.col("lod") == lod) & block_box(*box, edge)


def invalidate(resident: DataFrame, changed: Column) -> DataFrame:
    """The resident blocks that stay when those under ``changed`` are dropped."""
    return resident.where(~changed)


def ticks(log: DataFrame, length: int) -> DataFrame:
    """(tick, n, n_blocks, hits, admitted): a frozen set serves each tick of ``length`` requests, what it missed is resident from the next on."""
    at = log.withColumn("tick", F.floor(F.col("seq") / length))
    first = at.groupBy(*BLOCK).agg(F.min("tick").alias("first"))
    per_block = at.groupBy("tick", *BLOCK).agg(F.count(F.lit(1)).alias("n")).join(first, BLOCK)
    known = F.col("first") < F.col("tick")
    return per_block.groupBy("tick").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_blocks"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("hits"), F.count_if(~known).alias("admitted"))


def batch_update(log: DataFrame, catalog: DataFrame, length: int) -> DataFrame:
    """(tick, n_unique, present, zero, absent): each batch asks once for every block it names, and learns its state."""
    wanted = log.select(F.floor(F.col("seq") / length).alias("tick"), *BLOCK).distinct()
    states = wanted.join(catalog.select(*BLOCK, "state"), BLOCK, "left").withColumn("state", F.coalesce("state", F.lit(ABSENT)))
    return states.groupBy("tick").agg(F.count(F.lit(1)).alias("n_unique"), *(F.count_if(F.col("state") == k).alias(name) for k, name in ((1, "present"), (2, "zero"), (0, "absent"))))


def serve_blocks(log: DataFrame, catalog: DataFrame, blocks: DataFrame, edge: int) -> DataFrame:
    """(seq, state, data): every request with its block's bytes: as stored, zeros for one of air, null for one that is absent."""
    known = log.join(catalog.select(*BLOCK, "state"), BLOCK, "left").withColumn("state", F.coalesce("state", F.lit(ABSENT)))
    zeros = F.unhex(F.repeat(F.lit("00"), edge**3))
    served = known.join(blocks.select(*BLOCK, "data"), BLOCK, "left")
    return served.select("seq", "state", F.when(F.col("state") == PRESENT, F.coalesce("data", zeros)).when(F.col("state") != ABSENT, zeros).alias("data"))


def level_stats(catalog: DataFrame, log: DataFrame) -> DataFrame:
    """(lod, present, zero, requests, blocks_asked): what each level holds and was asked for."""
    held = catalog.groupBy("lod").agg(F.count_if(F.col("state") == 1).alias("present"), F.count_if(F.col("state") == 2).alias("zero"))
    asked = log.groupBy("lod").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("bz", "by", "bx").alias("blocks_asked"))
    both = held.join(asked, "lod", "full")
    return both.select("lod", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("present", "zero", "requests", "blocks_asked")))
