"""Analysis of block-access logs: cache replay, miss sets, request queues, generations, range coalescing."""

from __future__ import annotations

from collections import OrderedDict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FREQUENCY_CAP = 3


def access_log(events: DataFrame) -> DataFrame:
    """(seq, ts, lod, bz, by, bx): the events table read as block accesses."""
    e, u = F.col("event_id"), F.col("user_id")
    return events.select(e.alias("seq"), "ts", (u % 3).cast("int").alias("lod"), (e % 16).cast("int").alias("bz"), (u % 16).cast("int").alias("by"), ((e + u) % 16).cast("int").alias("bx"))


def block_key(lod: str = "lod") -> Column:
    return (F.col(lod).cast("long") * 4096 + F.col("bz") * 256 + F.col("by") * 16 + F.col("bx")).alias("key")


# ---------------------------------------------------------------- cache replay


class ClockCache:
    """Second chance: a hand passes slots, sparing each that was used since."""

    def __init__(self, slots: int):
        self.slots, self.ring, self.used, self.hand, self.evictions = slots, [], {}, 0, 0

    def access(self, key: int) -> bool:
        if key in self.used:
            self.used[key] = True
            return True
        if len(self.ring) < self.slots:
            self.ring.append(key)
        else:
            while self.used[self.ring[self.hand]]:
                self.used[self.ring[self.hand]] = False
                self.hand = (self.hand + 1) % self.slots
            del self.used[self.ring[self.hand]]
            self.evictions += 1
            self.ring[self.hand] = key
            self.hand = (self.hand + 1) % self.slots
        self.used[key] = True
        return False


class S3FifoCache:
    """A small queue, a main queue and a ghost list: keys seen once leave early, keys that come back go to main."""

    def __init__(self, slots: int):
        self.slots, self.small_least = slots, slots // 10 + 1
        self.small: deque = deque()
        self.main: deque = deque()
        self.frequency: dict[int, int] = {}
        self.ghost: OrderedDict = OrderedDict()
        self.evictions = 0

    def access(self, key: int) -> bool:
        if key in self.frequency:
            self.frequency[key] = min(self.frequency[key] + 1, FREQUENCY_CAP)
            return True
        if len(self.frequency) >= self.slots:
            self._evict()
        (self.main if key in self.ghost else self.small).append(key)
        self.frequency[key] = 0
        return False

    def _evict(self) -> None:
        while True:
            if len(self.small) >= self.small_least or not self.main:
                key = self.small.popleft()
                if self.frequency[key] > 0 and len(self.small) + len(self.main) > 0:
                    self.frequency[key] = 0
                    self.main.append(key)
                    continue
                self.ghost[key] = None
                self.ghost.move_to_end(key)
                if len(self.ghost) > self.slots:
                    self.ghost.popitem(last=False)
            else:
                key = self.main.popleft()
                if self.frequency[key] > 0:
                    self.frequency[key] -= 1
                    self.main.append(key)
                    continue
            del self.frequency[key]
            self.evictions += 1
            return


POLICIES = {"clock": ClockCache, "s3fifo": S3FifoCache}


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def replay(log: DataFrame, slots: int, policy: str = "s3fifo", shards: int = 64) -> DataFrame:
    """(shard, n, hits, misses, evictions) of an access log (seq, key), dealt into shards by its own column ``shard`` if it has one.

    A shard's accesses depend on each other, so a shard is replayed in one stream; its rows come
    sorted and pass in batches, and only the cache is held, whatever the log's length.
    """
    keyed = log.select("seq", "key", (F.col("shard").cast("int") if "shard" in log.columns else shard_of(F.col("key"), shards)).alias("shard"))

    def run(batches):
        shard, cache, n, hits = None, None, 0, 0
        out = []
        for pdf in batches:
            for s, key in zip(pdf["shard"].tolist(), pdf["key"].tolist(), strict=True):
                if s != shard:
                    if cache is not None:
                        out.append((shard, n, hits, n - hits, cache.evictions))
                    shard, cache, n, hits = s, POLICIES[policy](max(slots // shards, 1)), 0, 0
                n += 1
                hits += cache.access(key)
        if cache is not None:
            out.append((shard, n, hits, n - hits, cache.evictions))
        yield pd.DataFrame(out, columns=["shard", "n", "hits", "misses", "evictions"])

    return keyed.repartition("shard").sortWithinPartitions("shard", "seq").mapInPandas(run, "shard int, n long, hits long, misses long, evictions long")


# ---------------------------------------------------------------- sets and queues


def distinct_misses(log: DataFrame, resident: DataFrame) -> DataFrame:
    """Each block that was asked for and isn't resident, once, with when it was first asked for."""
    missed = log.join(resident, ["lod", "bz", "by", "bx"], "left_anti")
    return missed.groupBy("lod", "bz", "by", "bx").agg(F.min("seq").alias("first_seq"))


def request_queue(log: DataFrame, capacity: int) -> DataFrame:
    """Pending requests, newest first: each region once, by its latest request; the stalest beyond the capacity fall out."""
    return log.groupBy("lod", "bz", "by", "bx").agg(F.max("seq").alias("last_seq")).orderBy(F.desc("last_seq"), "lod", "bz", "by", "bx").limit(capacity)


def region_generations(log: DataFrame) -> DataFrame:
    """The latest change of every region, and of all."""
    per = log.groupBy("lod", "bz", "by", "bx").agg(F.max("seq").alias("generation"))
    everything = log.agg(F.max("seq").alias("generation")).select(*(F.lit(None).cast("int").alias(c) for c in ("lod", "bz", "by", "bx")), "generation")
    return per.unionByName(everything)


def coalesce_ranges(ranges: DataFrame, keys: list[str], gap: int, longest: int | None = None) -> DataFrame:
    """(keys, run_start, run_end, n): byte ranges (start, length) merged where gaps are at most ``gap``.

    Runs are sessions over the sorted ranges: a flag where the gap is too wide, its running sum as
    the run's number. ``longest`` cuts runs greedily at that many bytes, which depends on the
    order, so each run's ranges then pass in order through a fold that holds one open run.
    """
    w = Window.partitionBy(*keys).orderBy("start", "length")
    end = F.col("start") + F.col("length")
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = ranges.withColumn("_new", F.when(F.col("start") <= reach + gap, 0).otherwise(1))
    numbered = flagged.withColumn("_run", F.sum("_new").over(w))
    if longest is None:
        return numbered.groupBy(*keys, "_run").agg(F.min("start").alias("run_start"), F.max(end).alias("run_end"), F.count(F.lit(1)).alias("n")).drop("_run")

    kinds = {f.name: f.dataType.simpleString() for f in numbered.schema}
    own = [*keys, "_run"]

    def cut(batches):
        """Runs of a stream of sorted ranges; only the run that is open is held."""
        at, first, end, n, out = None, 0, 0, 0, []
        for pdf in batches:
            for row in pdf[[*own, "start", "length"]].itertuples(index=False, name=None):
                key, start, stop = row[:-2], row[-2], row[-2] + row[-1]
                if key == at and stop - first <= longest:
                    end, n = max(end, stop), n + 1
                    continue
                if n:
                    out.append((*at[:-1], first, end, n))
                at, first, end, n = key, start, stop, 1
            yield pd.DataFrame(out, columns=[*keys, "run_start", "run_end", "n"])
            out = []
        if n:
            yield pd.DataFrame([(*at[:-1], first, end, n)], columns=[*keys, "run_start", "run_end", "n"])

    rows = numbered.select(*own, "start", "length").repartition(*own).sortWithinPartitions(*own, "start", "length")
    return rows.mapInPandas(cut, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["run_start long, run_end long, n long"]))


def serve(log: DataFrame, chunks: DataFrame) -> DataFrame:
    """What each access is served: 1 present, 2 zeros, 0 absent (queued)."""
    return log.join(chunks.select("lod", "bz", "by", "bx", "state"), ["lod", "bz", "by", "bx"], "left").select("seq", F.coalesce("state", F.lit(0)).alias("state"))


def counters(replayed: DataFrame) -> DataFrame:
    return replayed.agg(*(F.sum(c).alias(c) for c in ("n", "hits", "misses", "evictions")))
