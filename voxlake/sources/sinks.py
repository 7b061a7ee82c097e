"""Row sinks: a table function that emits voxels of packed blocks inside SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf


@udtf(returnType="z int, y int, x int, v int")
class BlockVoxels:
    """Emits the material voxels of rows (bz, by, bx, edge, data) of a table argument."""

    def eval(self, row):
        edge = row["edge"]
        data = np.frombuffer(row["data"], np.uint8).reshape(edge, edge, edge)
        at = np.argwhere(data) + np.array([row["bz"], row["by"], row["bx"]]) * edge
        yield from zip(*at.T.tolist(), data[data > 0].tolist(), strict=True)


def voxel_rows(blocks: DataFrame, edge: int) -> DataFrame:
    """(z, y, x, v) of packed blocks (bz, by, bx, data), by ``block_voxels`` in SQL: a call a partition of the table argument."""
    spark = blocks.sparkSession
    spark.udtf.register("block_voxels", BlockVoxels)
    name = f"blocks_{uuid.uuid4().hex}"
    blocks.createOrReplaceTempView(name)
    try:
        return spark.sql(f"SELECT * FROM block_voxels(TABLE(SELECT bz, by, bx, {edge} AS edge, data FROM {name}) PARTITION BY (bz, by, bx))")
    finally:
        spark.catalog.dropTempView(name)
