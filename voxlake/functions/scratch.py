"""Tables of intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a session of one machine does without: on a cluster no other folder is shared."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"file://{tempfile.gettempdir()}/voxlake").rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """Where this session's tables lie, apart from those of others."""
    return f"{shared_dir(spark)}/voxlake/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables of this session. Frames that were made from them can't be read afterwards, so write results first."""
    _delete(spark, session_dir(spark))


#: Spark deletes the shuffle files of a query at its end; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet and read back: cuts the lineage of iterations and is computed once for several readers.

    Nothing reads the shuffles of the write afterwards, so their files go with it.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes materialized tables that nothing is made from any more: what was, has been written itself."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path is not None:
            _delete(table.sparkSession, path)
