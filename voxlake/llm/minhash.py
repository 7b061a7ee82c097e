"""MinHash near-duplicate groups with circulant signatures.

Two permutations make all signature coordinates: sigma places a shingle hash in a universe of
2**32 positions, and coordinate k is the least value of pi over the document's positions, pi shifted
circularly by k. Two shingles share a position with probability 2**-32, so a set of a million
shingles fills less than a thousandth of the universe. Coordinates are banded; documents that share a band are candidates, and a
link is confirmed on the full shingle sets. Components of links are the groups.

Identity. Documents of equal shingle sets, compared by 128-bit digests, form a class, whatever their
doc_ids; all that follows works on classes. A group of exact copies of any size is one class.

Candidates. Members of a band bucket are compared with two leaders of the bucket: a linear number of
pairs. What is left are buckets whose members are in different components afterwards; of those every pair of
different components is formed. Both steps take only pairs whose sketches allow a link (see ``sketch``): the filter is exact,
so no link is lost, and few pairs pass it that are not linked. With 32 bands of 6 rows two documents at the query's threshold of 0.85
miss every bucket with probability 3e-7, two at the stage's threshold of 0.8 with 6e-5.

Skew. Whatever is joined by a key that many rows can share (a band, a leader, a class) takes the
few keys of more than a thousandth of the rows by broadcast, and a frequent leader's members are
dealt over all partitions, with a copy of its set in each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, ROW_SQL, U64, discard, hot_keys, keyed, lookup, map_arrow, materialize, may_hold, mix, read_table, shingle_hashes, shuffle_partitions, slices, text_buffers
from ..operators.graph import connected_components

U32 = np.uint32
RING_BITS = 20
RING = 1 << RING_BITS
#: Least similarity of a link in the pipeline, in percent; the query has the default of Settings.
STAGE_PERCENT = 80
#: Bits of the sketch of every set, and of the wider one that sets of more than WIDE_FROM shingles have too.
SKETCH_BITS = 1 << 10
WIDE_BITS = 1 << 13
WIDE_FROM = 512
#: Members of a bucket that one task pairs with all others of it.
BLOCK_MEMBERS = 8192


@dataclass(frozen=True)
class Settings:
    percent: int = 85
    bands: int = 32
    rows: int = 6
    shingle_words: int = 5
    seed: int = 20


def sigma(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Positions in the universe: the upper half of a bijection of 64-bit hashes."""
    return (mix(hashes ^ U64(seed)) >> U64(32)).astype(U32)


@lru_cache(maxsize=2)
def _rings(seed: int, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of RING places, continued past its end so that each circular shift is a contiguous window, and an offset a ring."""
    rng = np.random.default_rng(seed)
    ring = rng.permutation(RING).astype(U32) << U32(32 - RING_BITS)
    rings = 1 << (32 - RING_BITS)
    offset = (rng.integers(0, RING, rings).astype(U32) << U32(32 - RING_BITS)) | np.arange(rings, dtype=U32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[: coordinates - 1]]), coordinates), offset


def pi(at: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """The second permutation of the universe, shifted circularly by each coordinate's number: a row a position, a column a coordinate.

    The universe is 2**12 rings of 2**20 places; a shift turns every ring. A place's value is that of its place in the ring plus
    the ring's offset. The lowest bits of it name the ring, the others then the place, so it is a bijection of 2**32 numbers.
    """
    windows, offset = _rings(settings.seed, settings.bands * settings.rows)
    return windows[at & U32(RING - 1)] + offset[at >> U32(RING_BITS)][:, None]


def signature(hashes: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """All coordinates of a non-empty set of shingle hashes."""
    at = sigma(hashes, settings.seed)
    out = pi(at[:1024], settings).min(0)
    for k in range(1024, len(at), 1024):
        np.minimum(out, pi(at[k : k + 1024], settings).min(0), out=out)
    return out


def band_keys(sig: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    parts = mix(sig.astype(U64).reshape(settings.bands, settings.rows) + (np.arange(settings.bands, dtype=U64) << U64(32))[:, None])
    weights = mix(np.arange(1, settings.rows + 1, dtype=U64)) | U64(1)
    return mix((parts * weights).sum(1, dtype=U64)).view(np.int64)


def digest(shingles: np.ndarray) -> np.ndarray:
    """128-bit identity of a shingle set, as two longs."""
    return np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)


def sketch(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The parity of the number of shingles in each of ``bits`` bins, as longs.

    A shingle that only one of two sets has changes one bit, so the sketches of the two differ in no more bits than the
    sets differ in shingles.
    """
    odd = np.bincount((shingles & U64(bits - 1)).view(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SKETCHES = ["n_shingles", "narrow", "wide"]
SIGNED = f"{ROW_SQL}, n_shingles long, set_hi long, set_lo long, bands array<long>, narrow array<long>, wide array<long>"
NONE = np.zeros(0, np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def signatures(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``keyed`` documents the size and digest of its shingle set, its band keys and its sketches (none for an empty set)."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(3))
            for lo, hi, part, off in slices(data, offsets):
                sizes, codes, bands, narrow, wide = [], [], [], [], []
                for h in shingle_hashes(part, off, settings.shingle_words):
                    sizes.append(len(h)), codes.append(digest(h))
                    bands.append(band_keys(signature(h, settings), settings) if len(h) else NONE)
                    narrow.append(sketch(h, SKETCH_BITS) if len(h) else NONE)
                    wide.append(sketch(h, WIDE_BITS) if len(h) > WIDE_FROM else NONE)
                codes = np.array(codes).reshape(-1, 2)
                keys = [batch.column(k).slice(lo, hi - lo) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(sizes, pa.int64()), pa.array(codes[:, 0]), pa.array(codes[:, 1]), _lists(bands), _lists(narrow), _lists(wide)], names=[*ROW, "n_shingles", "set_hi", "set_lo", "bands", "narrow", "wide"])

    return map_arrow(docs.select(*ROW, "text"), run, SIGNED)


# ---------------------------------------------------------------- comparing sets


def _salted(stars: DataFrame) -> DataFrame:
    """Adds ``salt``: members of a leader of more than a thousandth of all stars are dealt over the partitions."""
    hot = hot_keys(stars, ["leader"], stars.count()).withColumn("_hot", F.lit(True))
    spread = F.pmod(F.xxhash64("class"), F.lit(shuffle_partitions(stars.sparkSession))).cast("int")
    return stars.join(F.broadcast(hot), "leader", "left").withColumn("salt", F.when(F.col("_hot"), spread).otherwise(0)).drop("_hot")


SET_ROWS = pa.schema([("leader", pa.int64()), ("salt", pa.int32()), ("member", pa.bool_()), ("class", pa.int64()), ("shingles", pa.binary())])
MET = "leader long, class long, m long, n long, both long"


def compared(docs: DataFrame, classes: DataFrame, stars: DataFrame, settings: Settings) -> DataFrame:
    """(leader, class, m, n, both): sizes and overlap of the sets of every star.

    The sets are made anew from a text of each class, one join with the texts for all of them; each is
    then sent to the leaders it is compared with.
    """
    stars = materialize(_salted(stars), "op7-stars")
    lead = stars.select("leader", "salt").distinct().select("leader", "salt", F.lit(False).alias("member"), F.col("leader").alias("class"))
    sends = stars.select("leader", "salt", F.lit(True).alias("member"), "class").unionByName(lead)
    sends = sends.groupBy("class").agg(F.collect_list(F.struct("leader", "salt", "member")).alias("to"))
    wanted = materialize(sends.join(classes.select("class", "set_hi", "set_lo", "ref.*"), "class"), "op7-wanted")
    texts = may_hold(docs, wanted).join(wanted, list(ROW)).select("class", "set_hi", "set_lo", "to", "text")

    def make(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(4))
            for lo, hi, part, off in slices(data, offsets):
                names, his, los, tos = (batch.column(k).slice(lo, hi - lo).to_pylist() for k in range(4))
                out, size = [], 0
                for name, high, low, to, h in zip(names, his, los, tos, shingle_hashes(part, off, settings.shingle_words), strict=True):
                    if tuple(digest(h)) != (high, low):  # another text of the same 64-bit key
                        continue
                    body = h.tobytes()
                    for s in to:
                        out.append((s["leader"], s["salt"], s["member"], name, body))
                        size += len(body)
                        if size > 1 << 22:
                            yield _rows(out, SET_ROWS)
                            out, size = [], 0
                if out:
                    yield _rows(out, SET_ROWS)

    sets = map_arrow(texts, make, "leader long, salt int, member boolean, class long, shingles binary")
    sets = sets.repartition(shuffle_partitions(docs.sparkSession), "leader", "salt").sortWithinPartitions("leader", "salt", "member", "class")

    def meet(batches):
        at, own, last = None, None, None
        for batch in batches:
            for small in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                out = []
                for leader, salt, member, name, body in zip(*(small.column(k).to_pylist() for k in range(5)), strict=True):
                    h = np.frombuffer(body, U64)
                    if not member:
                        at, own, last = (leader, salt), h, None
                        continue
                    if (leader, salt) != at:
                        raise ValueError("a leader's set is missing")
                    if name == last:  # a row that occurs twice in the corpus
                        continue
                    last = name
                    place = np.minimum(np.searchsorted(own, h), len(own) - 1)
                    out.append((leader, name, len(own), len(h), int((own[place] == h).sum())))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["leader", "class", "m", "n", "both"])

    out = materialize(map_arrow(sets, meet, MET), "op7-met")
    discard(stars, wanted)
    return out


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


# ---------------------------------------------------------------- candidates


def _may_link(percent: int) -> Column:
    """False of rows p and q (SKETCHES) whose sets can't be linked: linked sets of n and m shingles differ in
    (n + m) (100 - percent) / (100 + percent) shingles at most, and their sketches in no more bits."""
    n, m = F.col("p.n_shingles"), F.col("q.n_shingles")
    similar = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    most = (n + m) * (100 - percent)
    bits = sum((F.bit_count(F.col("p.narrow")[k].bitwiseXOR(F.col("q.narrow")[k])) for k in range(1, SKETCH_BITS // 64)), F.bit_count(F.col("p.narrow")[0].bitwiseXOR(F.col("q.narrow")[0])))
    more = F.aggregate(F.zip_with("p.wide", "q.wide", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, b: s + b)
    return similar & (bits * (100 + percent) <= most) & ((F.size("p.wide") != F.size("q.wide")) | (more * (100 + percent) <= most))


def _band_stars(classes: DataFrame, n_classes: int) -> DataFrame:
    """(leader, class): every class with two classes of each of its band buckets, the least one and one by chance.

    A leader that most of a bucket is not linked to would leave all their pairs to ``_open_pairs``; two of them seldom do.
    """
    keys = classes.select("class", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("class").alias("least"), F.min_by("class", F.xxhash64("class", "key")).alias("any"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = materialize(buckets, "op7-buckets")
    # A class has a row a band, so frequent buckets are few.
    hot = buckets.where(F.col("size") * 1000 >= max(n_classes, 1000)).select("key")
    led = buckets.select("key", F.when(F.col("size") > 2, F.array("least", "any")).otherwise(F.array("least")).alias("leaders"))
    return lookup(keys, led, ["key"], hot).select(F.explode("leaders").alias("leader"), "class").where("class <> leader").distinct()


def _likely(stars: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The stars whose sketches allow a link."""
    sets = classes.select("class", *SKETCHES)
    p = sets.select(F.col("class").alias("leader"), F.struct(*SKETCHES).alias("p"))
    of = stars.join(sets.select("class", F.struct(*SKETCHES).alias("q")), "class")
    return lookup(of, p, ["leader"], hot_keys(stars, ["leader"], max(stars.count(), 1))).where(_may_link(percent)).select("leader", "class")


def _open_pairs(stars: DataFrame, classes: DataFrame, labels: DataFrame, n_classes: int, percent: int) -> DataFrame:
    """(leader, class): all pairs of a band bucket that are in different components and whose sketches allow a link.

    A bucket of more than one component is among those of a leader with members of more than one, so the buckets
    of other leaders are not made again.
    """
    own = stars.unionByName(stars.select("leader", F.col("leader").alias("class")).distinct())
    own = own.join(labels.toDF("class", "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    own = materialize(own, "op7-led")
    mixed = [F.min("component").alias("lo"), F.max("component").alias("hi")]
    open_ = own.groupBy("leader").agg(*mixed).where("lo < hi").select("leader")
    members = lookup(own, open_, ["leader"], hot_keys(own, ["leader"], max(n_classes, 1))).select("class", "component").distinct()
    keys = materialize(members.join(classes.select("class", "bands"), "class").select("class", "component", F.explode("bands").alias("key")), "op7-keys")
    buckets = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *mixed).where("lo < hi").select("key", "c"), "op7-buckets")
    hot = buckets.where(F.col("c") * 1000 >= max(n_classes, 1000)).select("key")
    # A bucket's pairs are found in blocks of its members, each by a task of its own. A member is sent to all blocks of its
    # bucket, so their number is kept small: no row is sent twice below BLOCK_MEMBERS.
    few = lookup(keys, buckets.select("key", (F.floor(F.col("c") / BLOCK_MEMBERS) + 1).alias("blocks")), ["key"], hot)
    few = few.join(classes.select("class", *SKETCHES), "class")
    p = few.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks"))).alias("p")
    q = few.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).alias("q")
    on = (F.col("p.key") == F.col("q.key")) & (F.col("p.block") == F.col("q.block")) & (F.col("p.class") < F.col("q.class")) & (F.col("p.component") != F.col("q.component"))
    out = p.join(q, on & _may_link(percent)).select(F.col("p.class").alias("leader"), F.col("q.class").alias("class")).distinct()
    out = materialize(out, "op7-pairs")
    discard(own, keys, buckets)
    return out


def _groups(docs: DataFrame, settings: Settings) -> DataFrame:
    """(*ROW, n_shingles, set_hi, set_lo, class, component, component_id) for every row of ``keyed`` documents.

    A row without shingles has no class. ``component`` is a class, ``component_id`` the least doc_id of its rows.
    """
    percent = settings.percent
    signed = materialize(signatures(docs, settings), "op7-signatures")
    filled = signed.where("n_shingles > 0")
    same = ["set_hi", "set_lo"]
    classes = filled.groupBy(*same).agg(F.min(F.struct("no_id", "id_key", "text_key")).alias("ref"), F.count(F.lit(1)).alias("n_rows"), *(F.first(c).alias(c) for c in ("bands", *SKETCHES)))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "op7-classes")
    n_classes = classes.count()

    def linked(stars: DataFrame) -> DataFrame:
        met = compared(docs, classes, stars, settings)
        return met.where(100 * F.col("both") >= percent * (F.col("n") + F.col("m") - F.col("both"))).select(F.col("leader").alias("a"), F.col("class").alias("b"))

    banded = materialize(_band_stars(classes, n_classes), "op7-stars")
    likely = materialize(_likely(banded, classes, percent), "op7-likely")
    labels = materialize(connected_components(linked(likely)), "op7-labels")
    pairs = _open_pairs(banded, classes, labels, n_classes, percent)
    discard(banded, likely)
    if not pairs.isEmpty():  # the components so far are stars already
        before, labels = labels, materialize(connected_components(linked(pairs).unionByName(labels.toDF("a", "b"))), "op7-labels")
        discard(before)
    discard(pairs)

    # Least doc_id of each component, by way of its classes; a component of one class has its own.
    first = F.when(~F.col("ref.no_id"), F.col("ref.id_key")).alias("first")
    member = classes.select("class", *same, "n_rows", first).join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    member = materialize(member, "op7-members")
    least = materialize(member.groupBy("component").agg(F.min("first").alias("component_id")), "op7-least")
    member = materialize(lookup(member, least, ["component"], hot_keys(member, ["component"], n_classes)), "op7-members")
    hot = member.where(F.col("n_rows") * 1000 >= max(signed.count(), 1000)).select(*same)
    grouped = lookup(filled.drop("bands", "narrow", "wide"), member.drop("n_rows", "first"), same, hot)
    own = F.when(~F.col("no_id"), F.col("id_key"))
    return grouped.unionByName(signed.where("n_shingles = 0").select(*ROW, "n_shingles", *same, F.lit(None).cast("long").alias("class"), F.lit(None).cast("long").alias("component"), own.alias("component_id")))


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text); other columns don't matter.

    Null and empty texts have no shingles, link with nothing and are kept. Texts of any length are taken whole.
    Every row counts by its text: rows that repeat a doc_id have a row each, and are in one group only if their
    texts are linked. Rows without a doc_id take part; a group of none but them has a null component_id. An
    empty table gives an empty result.
    """
    out = _groups(keyed(docs.select("doc_id", "text")), settings)
    return out.select(F.when(~F.col("no_id"), F.col("id_key")).alias("doc_id"), "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates of all documents, linked from a similarity of 0.85 on; awkward rows as in ``near_duplicates``."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group one document stays, the one of the least doc_id, with its columns as they are.

    Documents are linked from a similarity of 0.8 on. Of rows alike in doc_id and text one stays. Rows that
    repeat a doc_id with unlike texts stay; null and empty texts stay; a row without a doc_id stays only if its group
    has none with one. An empty table stays empty.
    """
    names, rows = docs.columns, keyed(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text"))
    groups = _groups(rows.select("doc_id", "text", *ROW), Settings(percent=STAGE_PERCENT))
    one = groups.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("no_id", "id_key", "text_key")).alias("r")).select("r.*")
    kept = one.unionByName(groups.where("component IS NULL").select("no_id", "id_key", "text_key").distinct())
    return rows.join(kept, list(ROW), "left_semi").dropDuplicates(list(ROW)).select(*(F.col(f"_row.`{n}`").alias(n) for n in names))
