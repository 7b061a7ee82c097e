"""The archive: an appendable Parquet store of encoded blocks with metadata.

Layout of a store directory: ``meta/`` holds versions of one row (dims, edges, quality, number of
levels, free text), ``blocks/`` rows (lod, cz, cy, cx, version, bz, by, bx, quality, payload, residual), and
``chunks/`` a row per appended chunk with its state, its fraction map and a hash chained over all its parts. Data is partitioned by ``lod`` and sorted by the
chunk's Morton number, so a box prunes files by their statistics. The newest version of a chunk wins.
"""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import ABSENT, AXES, PRESENT, ZERO, block_box, cell_of, dense_grid, morton, shift_of, voxel_box
from ..functions.order import ranked
from ..functions.scratch import materialize
from ..operators import codec as B
from ..operators.volume import block_stats

META = "nz int, ny int, nx int, block int, chunk int, quality double, max_error int, nlods int, codec int, metadata string, written long"
CHUNK_KEYS = ["lod", "cz", "cy", "cx"]
CHUNK_SQL = "lod int, cz int, cy int, cx int, version long, state int, nibbles map<int, int>, hash long"
BLOCK_SQL = "cz int, cy int, cx int, version long, bz int, by int, bx int, quality double, payload binary, residual binary, lod int"
META_LIMIT = 128 * 1024


@dataclass(frozen=True)
class Geometry:
    nz: int
    ny: int
    nx: int
    block: int = 16
    chunk: int = 256
    quality: float = 8.0
    max_error: int = 0
    nlods: int = 1
    codec: int = 0

    def __post_init__(self):
        if self.codec != 0:
            raise ValueError("0 is the only block codec")


class Archive:
    _last = 0

    def __init__(self, spark: SparkSession, path: str, geometry: Geometry):
        self.spark, self.path, self.geometry = spark, path.rstrip("/"), geometry
        self.codec = B.Codec.of(geometry.quality, geometry.max_error)

    # -- life cycle

    @staticmethod
    def create(spark: SparkSession, path: str, geometry: Geometry, metadata: str = "") -> Archive:
        out = Archive(spark, path, geometry)
        out._write_meta(metadata, 0)
        return out

    @staticmethod
    def open(spark: SparkSession, path: str, expect: tuple[int, int, int] | None = None) -> Archive:
        """An existing store; ``expect`` are dims that it must have."""
        row = Archive._meta(spark, path)
        g = Geometry(**{k: row[k] for k in Geometry.__dataclass_fields__})
        if expect is not None and expect != (g.nz, g.ny, g.nx):
            raise ValueError(f"the store has dims {(g.nz, g.ny, g.nx)}, not {expect}")
        return Archive(spark, path, g)

    @staticmethod
    def _meta(spark, path):
        return spark.read.schema(META).parquet(f"{path.rstrip('/')}/meta").orderBy(F.desc("written")).first()

    def _write_meta(self, text: str, version: int) -> None:
        if len(text.encode()) > META_LIMIT:
            raise ValueError("metadata is limited to 128 KB")
        row = {**asdict(self.geometry), "metadata": text, "written": version}
        names = [f.split()[0] for f in META.split(", ")]
        self.spark.createDataFrame([tuple(row[n] for n in names)], META).coalesce(1).write.mode("append").parquet(f"{self.path}/meta")

    @property
    def metadata(self) -> str:
        return self._meta(self.spark, self.path)["metadata"]

    def set_metadata(self, text: str) -> None:
        self._write_meta(text, self._meta(self.spark, self.path)["written"] + 1)

    def introspect(self) -> DataFrame:
        """One row of dims, edges, quality and levels."""
        g = self.geometry
        return self.spark.range(1).select(*(F.lit(getattr(g, k)).alias(k) for k in ("nz", "ny", "nx", "block", "chunk", "nlods", "quality")))

    # -- writing

    def append(self, voxels: DataFrame, lod: int = 0, quality: float | None = None, version: int | None = None, exact: bool = False) -> None:
        """Adds every chunk of ``voxels`` (z, y, x, v) of a level; chunks of air alone are recorded as such. With ``exact`` each
        block's residual is stored beside its payload, and it comes back as it was.

        Blocks are gathered by one grouping, encoded in Arrow batches and written with the commit
        protocol of the file writer; a chunk is visible once its row in ``chunks/`` is.
        """
        g, codec = self.geometry, B.Codec.of(quality, self.geometry.max_error) if quality is not None else self.codec
        version = version if version is not None else self._next_version()
        packed = B.pack_blocks(voxels, g.block)
        coded = B.encode_exact(packed, codec, g.block) if exact else B.encode(packed, codec, g.block).withColumn("residual", F.lit(None).cast("binary"))
        coded = materialize(coded.withColumn("quality", F.lit(float(codec.quality))), "coded")  # a range partitioner looks at its rows twice
        self._write_blocks(coded.select(F.lit(lod).alias("lod"), *self._chunk_of_block(), F.lit(version).alias("version"), "bz", "by", "bx", "quality", "payload", "residual"))
        state = F.when(F.max("v") > 0, PRESENT).otherwise(ZERO).alias("state")
        chunks = voxels.groupBy(*(cell_of(a, g.chunk).alias(f"c{a}") for a in AXES)).agg(state)
        # The fraction map: a nibble for each block with material, as many as a chunk has blocks at most.
        per = g.chunk // g.block
        inside = (F.pmod("bz", F.lit(per)) * per + F.pmod("by", F.lit(per))) * per + F.pmod("bx", F.lit(per))
        nibbles = block_stats(voxels, g.block).where("present").select(*self._chunk_of_block(), F.struct(inside.cast("int").alias("k"), "nibble").alias("e"))
        nibbles = nibbles.groupBy("cz", "cy", "cx").agg(F.map_from_entries(F.collect_list("e")).alias("nibbles"))
        chunks = chunks.join(nibbles, ["cz", "cy", "cx"], "left").join(block_parts(coded.select("*", *self._chunk_of_block()), ["cz", "cy", "cx"]), ["cz", "cy", "cx"], "left")
        chunks.select(F.lit(lod).alias("lod"), "cz", "cy", "cx", F.lit(version).alias("version"), "state", "nibbles", chunk_hash().alias("hash")).write.mode("append").parquet(f"{self.path}/chunks")

    def build(self, voxels: DataFrame, exact: bool = False) -> None:
        """All levels of detail of a volume; with ``exact`` each comes back as it was."""
        from ..operators.aggregate import decimate

        for lod in range(self.geometry.nlods):
            voxels = materialize(voxels, "level")  # written once: its blocks, its chunks and the next level come from it
            self.append(voxels, lod, exact=exact)
            voxels = decimate(voxels)

    def copy_from(self, other: Archive, box: tuple[int, ...] | None = None) -> None:
        """Verbatim copy of another store's payloads, of a box of chunks (z0, y0, x0, z1, y1, x1) if given; nothing is recoded."""
        blocks, chunks = other.blocks(), other.chunks()
        if box is not None:
            for a, lo, hi in zip(AXES, box[:3], box[3:], strict=True):
                blocks, chunks = (d.where(F.col(f"c{a}").between(lo, hi - 1)) for d in (blocks, chunks))
        version = self._next_version()
        self._write_blocks(blocks.withColumn("version", F.lit(version)))
        chunks.withColumn("version", F.lit(version)).select(*CHUNK_KEYS, "version", "state", "nibbles", "hash").write.mode("append").parquet(f"{self.path}/chunks")

    def update(self, voxels: DataFrame, exact: bool = False) -> None:
        """Appends chunks at level 0 and carries the change upwards: of each level above only the chunks over changed ones are
        made anew, from the stored blocks below them.
        """
        from ..operators.aggregate import decimate

        voxels = materialize(voxels.select(*AXES, "v"), "update")
        self.append(voxels, exact=exact)
        dirty = voxels.select(*(cell_of(a, self.geometry.chunk).alias(f"c{a}") for a in AXES)).distinct()
        for lod in range(1, self.geometry.nlods):
            above = [F.shiftright(c, 1).alias(c) for c in CHUNK_KEYS[1:]]
            dirty = materialize(dirty.select(*above).distinct(), "dirty")
            below = self.blocks().where(F.col("lod") == lod - 1)
            below = below.join(dirty.toDF("dz", "dy", "dx"), [F.shiftright(f"c{a}", 1) == F.col(f"d{a}") for a in AXES], "left_semi")
            # A voxel of air a chunk, so that one without material is recorded too.
            corner = dirty.select(*((F.col(f"c{a}") * self.geometry.chunk).cast("int").alias(a) for a in AXES), F.lit(0).alias("v"))
            self.append(decimate(self.decode(below)).select(*AXES, "v").unionByName(corner), lod, exact=exact)

    def append_target(self, voxels: DataFrame, ratio: float, lod: int = 0) -> float:
        """Appends at the quality that should reach a compression ratio, by a sample of blocks on a diagonal; returns it."""
        q = B.quality_for_ratio(B.pack_blocks(voxels, self.geometry.block), self.codec, ratio, self.geometry.block)
        self.append(voxels, lod, q)
        return q

    def set_priors(self, priors: DataFrame) -> None:
        """Stores a table of priors (band, p); of a band that is stored again the newest counts."""
        priors.select("band", "p", F.lit(self._next_version()).alias("version")).write.mode("append").parquet(f"{self.path}/priors")

    def priors(self) -> DataFrame:
        """The stored priors (band, p); none, if none were stored."""
        if not self._exists("priors"):
            return self.spark.createDataFrame([], "band int, p int")
        rows = self.spark.read.schema("band int, p int, version long").parquet(f"{self.path}/priors")
        return rows.groupBy("band").agg(F.max_by("p", "version").alias("p"))

    def _chunk_of_block(self):
        s = shift_of(self.geometry.chunk // self.geometry.block)
        return [F.shiftright(f"b{a}", s).alias(f"c{a}") for a in AXES]

    def _write_blocks(self, rows: DataFrame) -> None:
        cols = [*CHUNK_KEYS, "version", "bz", "by", "bx", "quality", "payload", "residual"]
        code = morton(F.col("cz"), F.col("cy"), F.col("cx"))
        rows.select(*cols, code.alias("code")).repartitionByRange(F.desc("lod"), "code").sortWithinPartitions(F.desc("lod"), "code", "bz", "by", "bx").drop("code").write.mode("append").partitionBy("lod").parquet(f"{self.path}/blocks")
        # Which chunks lie in which of the new files: their Morton interval and their box.
        version = rows.select(F.max("version")).first()[0]
        if version is not None:
            new = self.spark.read.schema(BLOCK_SQL).parquet(f"{self.path}/blocks").where(F.col("version") == version)
            ends = [f(c).alias(f"{c}_{n}") for c in ("code", *CHUNK_KEYS[1:]) for n, f in (("lo", F.min), ("hi", F.max))]
            new = new.select("lod", F.col("_metadata.file_path").alias("file"), *CHUNK_KEYS[1:], code.alias("code"))
            new.groupBy("lod", "file").agg(*ends).coalesce(1).write.mode("append").parquet(f"{self.path}/files")

    def _next_version(self) -> int:
        """Versions ascend by time of writing, and always within a process."""
        Archive._last = max(time.time_ns(), Archive._last + 1)
        return Archive._last

    # -- reading

    def _exists(self, name: str) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(conf).exists(at)

    def chunks(self) -> DataFrame:
        """The newest row of every chunk (lod, cz, cy, cx, version, state, nibbles, hash)."""
        schema = CHUNK_SQL
        if not self._exists("chunks"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/chunks")
        return rows.groupBy(*CHUNK_KEYS).agg(F.max("version").alias("version"), F.max_by("state", "version").alias("state"), F.max_by("nibbles", "version").alias("nibbles"), F.max_by("hash", "version").alias("hash"))

    def fractions(self, lod: int = 0) -> DataFrame:
        """(bz, by, bx, fraction) of blocks with material, from the stored maps alone: no block is read."""
        per = self.geometry.chunk // self.geometry.block
        rows = self.chunks().where(F.col("lod") == lod).select("cz", "cy", "cx", F.explode("nibbles").alias("k", "nibble"))
        at = {"bz": F.expr(f"k DIV {per * per}"), "by": F.expr(f"k DIV {per} % {per}"), "bx": F.col("k") % per}
        return rows.select(*((F.col(f"c{b[1]}") * per + e).cast("int").alias(b) for b, e in at.items()), (F.col("nibble") / 15.0).alias("fraction"))

    def all_air(self, lod: int = 0) -> DataFrame:
        """(cz, cy, cx, air) of the whole grid from the chunk table: 1 all air, 0 with material, -1 never written."""
        air = F.when(F.col("state") == ZERO, 1).when(F.col("state") == PRESENT, 0).otherwise(-1)
        return self.coverage(lod).select("cz", "cy", "cx", air.alias("air"))

    def blocks(self) -> DataFrame:
        """Blocks of the newest version of every chunk. Filters on lod, chunk and block reach the scan."""
        schema = BLOCK_SQL
        if not self._exists("blocks"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/blocks")
        return rows.join(self.chunks().select(*CHUNK_KEYS, "version"), [*CHUNK_KEYS, "version"], "left_semi")

    def files(self) -> DataFrame:
        """(lod, file, and the least and greatest Morton number and coordinates of its chunks) of all files of blocks."""
        ends = ", ".join(f"{c}_{n} {'long' if c == 'code' else 'int'}" for c in ("code", "cz", "cy", "cx") for n in ("lo", "hi"))
        return self.spark.read.schema(f"lod int, file string, {ends}").parquet(f"{self.path}/files")

    def near(self, lod: int, z0: int, y0: int, x0: int, dz: int, dy: int, dx: int) -> DataFrame:
        """Blocks of a level in the files that can hold chunks of a box: files are chosen by the table of their contents, before the scan."""
        if not self._exists("files"):
            return self.blocks().where(F.col("lod") == lod)
        s = shift_of(self.geometry.chunk)
        first = [max(lo, 0) >> s for lo in (z0, y0, x0)]
        last = [(lo + n - 1) >> s for lo, n in zip((z0, y0, x0), (dz, dy, dx), strict=True)]
        holds = F.col("lod") == lod
        for c, lo, hi in zip(CHUNK_KEYS[1:], first, last, strict=True):
            holds = holds & (F.col(f"{c}_hi") >= lo) & (F.col(f"{c}_lo") <= hi)
        # Morton numbers ascend in every coordinate, so those of a box lie between its corners'.
        holds = holds & (F.col("code_hi") >= morton(*map(F.lit, first))) & (F.col("code_lo") <= morton(*(F.lit(max(k, 0)) for k in last)))
        found = [r["file"] for r in self.files().where(holds).select("file").distinct().collect()]
        if not found:
            return self.blocks().where("false")
        rows = self.spark.read.schema(BLOCK_SQL).option("basePath", f"{self.path}/blocks").parquet(*found)
        return rows.join(self.chunks().select(*CHUNK_KEYS, "version"), [*CHUNK_KEYS, "version"], "left_semi")

    def coverage(self, lod: int = 0) -> DataFrame:
        g = self.geometry
        dims = [-(-(n >> lod) // g.chunk) or 1 for n in (g.nz, g.ny, g.nx)]
        grid = dense_grid(self.spark, *dims).toDF("cz", "cy", "cx")
        return grid.join(self.chunks().where(F.col("lod") == lod), ["cz", "cy", "cx"], "left").select("cz", "cy", "cx", F.coalesce("state", F.lit(ABSENT)).alias("state"))

    def decode(self, blocks: DataFrame) -> DataFrame:
        """(z, y, x, v) of encoded blocks, each by the quality it was written with."""
        return B.unpack_blocks(self.decoded(blocks), self.geometry.block)

    def decoded(self, blocks: DataFrame) -> DataFrame:
        """(bz, by, bx, data) of encoded blocks."""
        return B.decode_mixed(blocks, self.geometry.max_error, self.geometry.block)

    def observed_decode(self, lod: int = 0) -> DataFrame:
        """One row of what a pass over a level saw: blocks, bytes of payloads, damaged blocks, decoded ones and voxels with material.

        All are observed in the same job, by its own tasks; nothing is read or decoded for the counts.
        """
        scan, decode, out = (Observation(f"{n}-{self._next_version()}") for n in ("scan", "decode", "voxels"))
        rows = self.blocks().where(F.col("lod") == lod)
        rows = rows.observe(scan, F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(F.octet_length("payload").cast("long")), F.lit(0)).alias("bytes"))
        data = B.decode_mixed(rows, self.geometry.max_error, self.geometry.block, tolerant=True)
        data = data.observe(decode, F.count_if(F.col("data").isNull()).alias("errors"), F.count_if(F.col("data").isNotNull()).alias("decoded"))
        voxels = B.unpack_blocks(data.where("data IS NOT NULL"), self.geometry.block).observe(out, F.count(F.lit(1)).alias("voxels"))
        materialize(voxels, "observed")
        seen = scan.get | decode.get | out.get
        return self.spark.range(1).select(*(F.lit(seen[n]).cast("long").alias(n) for n in ("blocks", "bytes", "errors", "decoded", "voxels")))

    def region(self, z0: int, y0: int, x0: int, dz: int, dy: int, dx: int, lod: int = 0) -> DataFrame:
        """Material voxels of a box: only the blocks that it touches are read and decoded."""
        g = self.geometry
        touched = self.near(lod, z0, y0, x0, dz, dy, dx).where(block_box(z0, y0, x0, dz, dy, dx, g.chunk, "c")).where(block_box(z0, y0, x0, dz, dy, dx, g.block))
        return self.decode(touched).where(voxel_box(z0, y0, x0, dz, dy, dx))

    def verify(self) -> DataFrame:
        """Chunks whose stored blocks don't have the hash that was stored with the chunk: changed, added or missing, whether or not
        they decode. Nothing is decoded."""
        now = self.chunks().join(block_parts(self.blocks(), CHUNK_KEYS), CHUNK_KEYS, "left")
        return now.where(~chunk_hash().eqNullSafe(F.col("hash"))).select(*CHUNK_KEYS)

    def read_states(self, lod: int = 0) -> DataFrame:
        """(bz, by, bx, state) of stored blocks: PRESENT, or -1 where the payload can't be decoded. What has no row is absent."""
        rows = B.decode_mixed(self.blocks().where(F.col("lod") == lod), self.geometry.max_error, self.geometry.block, tolerant=True)
        return rows.select("bz", "by", "bx", F.when(F.col("data").isNull(), -1).otherwise(PRESENT).alias("state"))

    def export_order(self) -> DataFrame:
        """Blocks with their position in an export: coarsest level first, then Morton order."""
        coded = self.blocks().withColumn("code", morton(F.col("cz"), F.col("cy"), F.col("cx")))
        return ranked(coded, [F.desc("lod"), F.col("code"), F.col("bz"), F.col("by"), F.col("bx")], "position").withColumn("position", F.col("position") - 1)


def block_parts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parts): place, length and hash of every block of a chunk, in their order. A chunk has a bounded number of them."""
    own = F.xxhash64("quality", "payload", "residual")
    length = F.coalesce(F.octet_length("payload"), F.lit(0)) + F.coalesce(F.octet_length("residual"), F.lit(0))
    return blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bz", "by", "bx", length.alias("length"), own.alias("own")))).alias("parts"))


def chunk_hash() -> Column:
    """A hash chained over a chunk's fraction map, its blocks' places, their lengths and their contents, one after the other: each is
    the seed of the next, so the order counts. From columns nibbles and parts."""
    fractions = F.sort_array(F.coalesce(F.map_entries("nibbles"), F.expr("CAST(array() AS array<struct<key: int, value: int>>)")))
    parts = F.coalesce("parts", F.expr("CAST(array() AS array<struct<bz: int, by: int, bx: int, length: int, own: bigint>>)"))
    head = F.xxhash64(F.xxhash64(F.xxhash64(fractions), F.transform(parts, lambda p: F.struct(p["bz"], p["by"], p["bx"]))), F.transform(parts, lambda p: p["length"]))
    return F.aggregate(parts, head, lambda seed, p: F.xxhash64(seed, p["own"]))


def probe(spark: SparkSession, path: str) -> Geometry:
    """Dims, levels and quality of a store, without reading a block."""
    return Archive.open(spark, path).geometry
