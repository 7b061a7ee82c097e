"""Levels of detail kept up by a stream of changed chunks, and what its batches reported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.store import Archive


def keep_up(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that takes each micro-batch of voxels (z, y, x, v) as changed chunks of the store at ``path``.

    A batch that is run again after a failure appends the same chunks once more; the newest version of a chunk counts, so
    the store is the same. The batches' voxels and material are observed as ``changes``.
    """
    seen = stream.observe("changes", F.count(F.lit(1)).alias("voxels"), F.count_if(F.col("v") > 0).alias("material"))

    def step(batch: DataFrame, _: int) -> None:
        Archive.open(batch.sparkSession, path).update(batch)  # which reads the batch once, so its rows are observed once

    return seen.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Keeps what every batch reported, and calls ``ready`` after each that had rows."""

    def __init__(self, ready: Callable[[dict], None] | None = None):
        self.batches: list[dict] = []
        self.ready = ready

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        row = {"batch": p.batchId, "rows": p.numInputRows} | {k: v.asDict() for k, v in p.observedMetrics.items()}
        self.batches.append(row)
        if p.numInputRows and self.ready is not None:
            self.ready(row)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
