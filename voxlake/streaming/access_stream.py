"""The access log as a stream: generations, windows and deduplicated misses under watermarks, cache replay by state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.access import POLICIES, shard_of

REGION = ["lod", "bz", "by", "bx"]


def timed(stream: DataFrame) -> DataFrame:
    """Timestamps with the session's zone, which watermarks need."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Accesses per window and level; rows later than the watermark are dropped."""
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed(stream).withWatermark("ts", late).groupBy(win.alias("w"), "lod").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "lod", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of accesses to a level without a pause of ``gap``."""
    return timed(stream).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "lod").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "lod", "n")


def first_misses(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each region once while the watermark remembers it."""
    return timed(stream).withWatermark("ts", late).dropDuplicatesWithinWatermark(REGION)


def generations(stream: DataFrame) -> DataFrame:
    """The latest change of every region, updated batch by batch; state is a row per region."""
    return stream.groupBy(*REGION).agg(F.max("seq").alias("generation"))


def replay_stream(stream: DataFrame, slots: int, policy: str = "s3fifo", shards: int = 64) -> DataFrame:
    """(shard, n, hits, misses, evictions) after each batch: the cache of a shard is its state.

    Within a batch a shard's rows are replayed by ``seq``; a batch's rows must not be older than those before.
    """
    keyed = stream.select("seq", "key", shard_of(F.col("key"), shards).alias("shard"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, hits, cache = (*state.get[:2], pickle.loads(state.get[2])) if state.exists else (0, 0, POLICIES[policy](max(slots // shards, 1)))
        rows = pd.concat(frames).sort_values("seq")
        for k in rows["key"].tolist():
            n += 1
            hits += cache.access(k)
        state.update((n, hits, pickle.dumps(cache)))
        yield pd.DataFrame({"shard": [key[0]], "n": [n], "hits": [hits], "misses": [n - hits], "evictions": [cache.evictions]})

    return keyed.groupBy("shard").applyInPandasWithState(step, "shard int, n long, hits long, misses long, evictions long", "n long, hits long, cache binary", "update", GroupStateTimeout.NoTimeout)
