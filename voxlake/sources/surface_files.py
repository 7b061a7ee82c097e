"""Surface, image and volume files: OBJ grids and meshes, ordered per-pixel maps, PPM images, raw boxes.

Texts are read by splits and numbered by running counts over their lines; binary files are read by ranges
of records. All are written by tasks, in parts that are put together (``one_file``). Files hold (x, y, z), tables (z, y, x).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import AXES, dense_grid, voxel_box
from ..functions.order import ranked, running
from .one_file import read_head, read_records, write_lines, write_records

# ---------------------------------------------------------------- text


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(block, row, p): the words of every line that has some; block and row order them."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return text.where("trim(value) <> ''").select("block", "row", F.split(F.trim("value"), r"\s+").alias("p"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``seen``, the vertices up to and with them."""
    is_vertex = F.when(F.element_at("p", 1) == "v", 1).otherwise(0).cast("long")
    return running(_lines(spark, path), [F.col("block"), F.col("row")], is_vertex, "seen")


def _vertices(lines: DataFrame) -> DataFrame:
    return lines.where((F.element_at("p", 1) == "v") & (F.size("p") >= 4)).select((F.col("seen") - 1).alias("k"), *(F.element_at("p", i).cast("double").alias(c) for i, c in ((2, "x"), (3, "y"), (4, "z"))))


def load_obj_grid(spark: SparkSession, path: str) -> DataFrame:
    """(gy, gx, pz, py, px) of a grid that names its size in ``# grid gw gh``, else a single row.

    ``# cell`` before a vertex says which cell it is, else vertices fill the grid in order.
    """
    lines = _numbered(spark, path)
    word = lambda k: F.element_at("p", k)
    size = lines.where((F.size("p") >= 4) & (word(1) == "#") & (word(2) == "grid")).select(word(3).cast("int").alias("gw")).first()
    v = _vertices(lines).select("k", F.col("z").alias("pz"), F.col("y").alias("py"), F.col("x").alias("px"))
    if size is None:
        return v.select(F.lit(0).alias("gy"), F.col("k").cast("int").alias("gx"), "pz", "py", "px")
    cells = lines.where((F.size("p") >= 3) & (word(1) == "#") & (word(2) == "cell")).groupBy(F.col("seen").alias("k")).agg(F.max(word(3).cast("long")).alias("cell"))
    at = F.coalesce("cell", "k")
    return v.join(cells, "k", "left").select(F.floor(at / size["gw"]).cast("int").alias("gy"), (at % size["gw"]).cast("int").alias("gx"), "pz", "py", "px")


def _number(value: Column) -> Column:
    """A double as text that reads back the same."""
    return F.when(value == F.floor(value), F.when(F.abs(value) < 1e15, value.cast("long").cast("string")).otherwise(value.cast("string"))).otherwise(value.cast("string"))


def save_obj_grid(grid: DataFrame, gw: int, gh: int, path: str) -> None:
    """An OBJ of a grid (gy, gx, pz, py, px): valid points, two triangles per cell whose four corners are valid."""
    valid = grid.where("pz IS NOT NULL").select("gy", "gx", "pz", "py", "px")
    v = ranked(valid, [F.col("gy"), F.col("gx")], "number")
    cell = F.col("gy").cast("long") * gw + F.col("gx")
    point = F.concat(F.lit("# cell "), cell, F.lit("\nv "), F.concat_ws(" ", _number(F.col("px")), _number(F.col("py")), _number(F.col("pz"))))
    n = v.select("gy", "gx", "number")
    corners = n
    for name, dy, dx in (("right", 0, 1), ("below", 1, 0), ("across", 1, 1)):
        corners = corners.join(n.select((F.col("gy") - dy).alias("gy"), (F.col("gx") - dx).alias("gx"), F.col("number").alias(name)), ["gy", "gx"])
    corners = corners.where((F.col("gy") < gh - 1) & (F.col("gx") < gw - 1))
    faces = F.format_string("f %d %d %d\nf %d %d %d", "number", "right", "below", "right", "across", "below")
    head = grid.sparkSession.range(1).select(F.lit(0).alias("section"), F.lit(0).alias("gy"), F.lit(0).alias("gx"), F.lit(f"# grid {gw} {gh}").alias("text"))
    lines = head.unionByName(v.select(F.lit(1).alias("section"), "gy", "gx", point.alias("text"))).unionByName(corners.select(F.lit(2).alias("section"), "gy", "gx", faces.alias("text")))
    write_lines(lines, [F.col("section"), F.col("gy"), F.col("gx")], path)


def load_obj_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vid, x, y, z) and (tid, a, b, c), vertices from 0: polygons are fanned, negative indices count
    from the latest vertex, faces with an index out of range are dropped."""
    lines = _numbered(spark, path)
    v = _vertices(lines)
    n = v.count()
    faces = lines.where((F.element_at("p", 1) == "f") & (F.size("p") >= 4))
    index = F.transform(F.slice("p", 2, F.size("p") - 1), lambda s: F.regexp_extract(s, r"^(-?\d+)", 1).cast("long"))
    faces = faces.select("block", "row", "seen", index.alias("i")).withColumn("i", F.transform("i", lambda k: F.when(k < 0, F.col("seen") + k).otherwise(k - 1)))
    faces = faces.where(F.forall("i", lambda k: (k >= 0) & (k < n)))
    fans = running(faces, [F.col("block"), F.col("row")], (F.size("i") - 2).cast("long"), "end")
    tri = fans.select("i", "end", F.explode(F.sequence(F.lit(1), F.size("i") - 2)).alias("k"))
    tri = tri.select((F.col("end") - F.size("i") + 1 + F.col("k")).cast("int").alias("tid"), *(F.element_at("i", at).cast("int").alias(c) for c, at in (("a", F.lit(1)), ("b", F.col("k") + 1), ("c", F.col("k") + 2))))
    return v.select(F.col("k").cast("int").alias("vid"), "x", "y", "z"), tri


def save_obj_mesh(vertices: DataFrame, triangles: DataFrame, path: str) -> None:
    """An OBJ of vertices (vid, x, y, z) and triangles (tid, a, b, c), both numbered from 0 without gaps."""
    v = vertices.select(F.lit(0).alias("section"), F.col("vid").alias("k"), F.concat_ws(" ", F.lit("v"), *(_number(F.col(c)) for c in "xyz")).alias("text"))
    t = triangles.select(F.lit(1).alias("section"), F.col("tid").alias("k"), F.concat_ws(" ", F.lit("f"), *(F.col(c) + 1 for c in "abc")).alias("text"))
    write_lines(v.unionByName(t), [F.col("section"), F.col("k")], path)


# ---------------------------------------------------------------- records


def save_pixel_map(grid: DataFrame, gw: int, gh: int, path: str) -> None:
    """A map of doubles (x, y, z, and three of 0) a cell; invalid cells are zeros."""
    k = F.col("gy").cast("long") * gw + F.col("gx")
    cells = grid.sparkSession.range(gw * gh).withColumnRenamed("id", "k").join(grid.select(k.alias("k"), "px", "py", "pz"), "k", "left")

    def encode(batch):
        out = np.zeros((batch.num_rows, 6), "<f8")
        for c, name in enumerate(("px", "py", "pz")):
            out[:, c] = np.nan_to_num(batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False))
        return out.view(np.uint8).reshape(batch.num_rows, 48)

    header = f"width: {gw}\nheight: {gh}\ndim: 6\nordered: true\ntype: double\nversion: 1\n<>\n".encode()
    write_records(cells.select("k", "px", "py", "pz"), path, header, 48, encode)


def load_pixel_map(spark: SparkSession, path: str, depth: float) -> DataFrame:
    """(gy, gx, pz, py, px, depth) of a header of ``key: value`` lines up to ``<>`` and rows of doubles; (0, 0, 0) is invalid: null, with depth 0."""
    head, mark, _ = read_head(path).partition(b"<>\n")
    if not mark:
        raise ValueError(f"{path} has no header")
    fields = dict(line.split(":", 1) for line in head.decode().splitlines() if ":" in line)
    w, h, dim = (int(fields[k]) for k in ("width", "height", "dim"))
    names = ["gy", "gx", "pz", "py", "px", "depth"]

    def decode(k, data):
        p = np.ascontiguousarray(data).view("<f8")[:, :3]
        bad = (p == 0).all(1)
        cols = [pa.array((k // w).astype(np.int32)), pa.array((k % w).astype(np.int32)), *(pa.array(np.ascontiguousarray(p[:, c]), mask=bad) for c in (2, 1, 0)), pa.array(np.where(bad, 0.0, depth))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return read_records(spark, path, len(head) + 3, 8 * dim, w * h, decode, "gy int, gx int, pz double, py double, px double, depth double")


def save_ppm(image: DataFrame, width: int, height: int, path: str) -> None:
    """A binary PPM of (i, j, val) or (i, j, argb); gray values are repeated for the three channels, pixels without a row are black."""
    colour = "argb" in image.columns
    k = F.col("i").cast("long") * width + F.col("j")
    pixels = image.sparkSession.range(width * height).withColumnRenamed("id", "k").join(image.select(k.alias("k"), F.col("argb" if colour else "val").cast("long").alias("v")), "k", "left").select("k", F.coalesce("v", F.lit(0)).alias("v"))

    def encode(batch):
        v = batch.column(1).to_numpy()
        return np.stack([v >> (16 - 8 * c) & 255 if colour else v for c in range(3)], 1).astype(np.uint8)

    write_records(pixels, path, f"P6\n{width} {height}\n255\n".encode(), 3, encode)


def load_ppm(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, r, g, b) of a binary PPM without comments."""
    head = read_head(path, 64)
    kind, width, height, top = head.split(None, 4)[:4]
    if kind != b"P6" or top != b"255":
        raise ValueError(f"{path} is not a PPM of bytes")
    first = len(head) - len(head.split(None, 3)[3]) + len(top) + 1
    w = int(width)

    def decode(k, data):
        cols = [pa.array((k // w).astype(np.int32)), pa.array((k % w).astype(np.int32)), *(pa.array(data[:, c].astype(np.int32)) for c in range(3))]
        return pa.RecordBatch.from_arrays(cols, names=["i", "j", "r", "g", "b"])

    return read_records(spark, path, first, 3, w * int(height), decode, "i int, j int, r int, g int, b int")


def save_raw(voxels: DataFrame, box: tuple[int, int, int, int, int, int], path: str) -> None:
    """The bytes of a dense box (z0, y0, x0, dz, dy, dx) of voxels (z, y, x, v), air and what is missing as 0."""
    dims = box[3:]
    place = lambda *c: (c[0].cast("long") * dims[1] + c[1]) * dims[2] + c[2]
    there = voxels.where(voxel_box(*box)).select(place(*(F.col(a) - lo for a, lo in zip(AXES, box[:3], strict=True))).alias("k"), "v")
    cells = dense_grid(voxels.sparkSession, *dims).select(place(*map(F.col, AXES)).alias("k")).join(there, "k", "left")
    write_records(cells.select("k", F.coalesce("v", F.lit(0)).alias("v")), path, b"", 1, lambda b: b.column(1).to_numpy().astype(np.uint8)[:, None])


def load_raw(spark: SparkSession, path: str, dims: tuple[int, int, int], first: int = 0) -> DataFrame:
    """(z, y, x, v) of the material voxels of a file of dims bytes, after ``first`` bytes of something else."""

    def decode(k, data):
        on = np.flatnonzero(data[:, 0])
        at = np.unravel_index(k[on], dims)
        return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in at), pa.array(data[on, 0].astype(np.int32))], names=[*AXES, "v"])

    return read_records(spark, path, first, 1, int(np.prod(dims)), decode, "z int, y int, x int, v int")
