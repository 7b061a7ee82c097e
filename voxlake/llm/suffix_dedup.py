"""Suffix-array dedup: every byte of a long string that occurs elsewhere in the corpus is removed.

A suffix array of the whole corpus would hold a row per byte. Instead the suffixes are dealt into
groups that can be sorted apart: the key of a suffix is the least hash of the 32-byte grams in
its first LENGTH bytes, so suffixes that agree in LENGTH bytes share a key. About 85 neighbouring
suffixes have the same key; they form a run of MAX_RUN suffixes at most, the unit that is counted
and shuffled. Then:

1. Runs whose key occurs once in the corpus repeat nothing; a grouped count finds the others.
2. Runs of one key with the same bytes, by a cryptographic 128-bit digest, repeat each other fully.
3. The distinct contents that are left under a key are fetched and their suffixes sorted. Suffixes
   that agree in LENGTH bytes have the key's gram at the same distance, and agree in the bytes that all
   suffixes of about that distance (a band of distances) hold; what has no partner by these needs no
   sorting. Suffixes are compared by prefix polynomial hashes modulo 2**61 - 1: binary search finds
   their common extension in eight steps, the byte after it decides. A bottom-up mergesort places every
   suffix of a run among its partner run by binary search, so each needs a logarithmic number of
   comparisons. Neighbours that agree in LENGTH bytes by hash are verified on the bytes; a collision
   makes the group be sorted anew by bytes.
4. A key with more than GROUP_LIMIT distinct contents is too much for one task. It is split by the same
   two things, the band of the distance and the bytes that the band's suffixes share: each content is
   cut into a piece a band, and pieces go through 2 and 3 as contents of smaller groups. Bands of one distance
   at last have one content a group, so the splitting ends, and no group is ever sampled or cut.

Null texts count as empty. Rows that repeat a doc_id are documents of their own: with the same text they
repeat each other. Texts shorter than LENGTH bytes stay whole, long ones are taken in overlapping pieces, so
memory doesn't follow them; null ids and other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, ROW_SQL, SLICE_BYTES, U64, discard, keyed, lookup, map_arrow, materialize, may_hold, mix, prefix_hashes, prime_powers, prime_prefixes, range_hashes, read_table, shuffle_partitions, slices, text_buffers, times

LENGTH = 200
GRAM = 32
WINDOW = LENGTH - GRAM + 1
MAX_RUN = 512
GROUP_LIMIT = 2000
GROUP_BYTES = 1 << 19
#: Distances of the key's gram that are taken together: within a task, and where a group is split over tasks.
BAND = 43
SPLIT_BANDS = (16, 1)


# ---------------------------------------------------------------- runs


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, in two passes over blocks."""
    n = len(x)
    if n < width:
        return np.zeros(0, x.dtype)
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def gram_hashes(data: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    at = np.arange(max(len(data) - GRAM + 1, 0))
    return mix(range_hashes(prefix, at, at + GRAM))


def runs(data: np.ndarray, offsets: np.ndarray):
    """(row, start in the row, suffixes, key, whether the key's gram occurs twice in it) of all runs."""
    prefix = prefix_hashes(data)
    grams = gram_hashes(data, prefix)
    least = sliding_min(grams, WINDOW)
    n = len(least)
    valid = np.zeros(n + 1, np.int8)
    size = np.diff(offsets)
    long = np.flatnonzero(size >= LENGTH)
    begin, end = offsets[long], offsets[long + 1] - LENGTH + 1
    np.add.at(valid, begin, 1)
    np.add.at(valid, end, -1)
    inside = np.cumsum(valid[:n]).astype(bool)
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(fresh)
    if not len(first):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64), np.zeros(0, bool))
    row = np.searchsorted(offsets, first, side="right") - 1
    stop = np.minimum(np.append(first[1:], n), offsets[row + 1] - LENGTH + 1)
    # Long runs (periodic text) in parts.
    parts = -(-(stop - first) // MAX_RUN)
    if parts.max() > 1:
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, stop, row = np.repeat(first, parts) + k * MAX_RUN, np.repeat(stop, parts), np.repeat(row, parts)
        stop = np.minimum(stop, first + MAX_RUN)
    key = least[first]
    # Occurrences of the key's gram in a run: few grams are as small as any key.
    small = np.flatnonzero(grams <= key.max())
    lo, hi = np.searchsorted(small, first), np.searchsorted(small, stop + WINDOW - 1)
    many = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    equal = grams[small[at]] == np.repeat(key, many)
    twice = np.add.reduceat(equal, np.concatenate([[0], np.cumsum(many)[:-1]]), dtype=np.int64) > 1
    return row, first - offsets[row], stop - first, key, twice


def pieces(data: np.ndarray, offsets: np.ndarray):
    """(first row, start in it, bytes, offsets) of slices; a row longer than a slice comes in pieces that overlap by LENGTH - 1 bytes."""
    for lo, hi, part, off in slices(data, offsets):
        if hi - lo == 1 and len(part) > SLICE_BYTES + LENGTH:
            for at in range(0, len(part) - LENGTH + 1, SLICE_BYTES):
                cut = part[at : at + SLICE_BYTES + LENGTH - 1]
                yield lo, at, cut, np.array([0, len(cut)])
        else:
            yield lo, 0, part, off


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def run_table(docs: DataFrame, digests: bool = True) -> DataFrame:
    """(key, twice) of all runs of ``keyed`` documents, with ``digests`` also (hi, lo, *ROW, start, suffixes, weight)."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(3))
            for lo, base, part, off in pieces(data, offsets):
                row, start, count, key, twice = runs(part, off)
                out = [pa.array(key.view(np.int64)), pa.array(twice)]
                if digests:
                    blob, first = part.tobytes(), off[row] + start
                    codes = b"".join([_digest(blob[a:b]) for a, b in zip(first.tolist(), (first + count + LENGTH - 1).tolist(), strict=True)])
                    codes = np.frombuffer(codes, np.int64).reshape(-1, 2)
                    rows = pa.array(row + lo)
                    out += [pa.array(codes[:, 0]), pa.array(codes[:, 1]), *(batch.column(k).take(rows) for k in range(3)), pa.array((start + base).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(np.ones(len(row), np.int64))]
                yield pa.RecordBatch.from_arrays(out, names=["key", "twice", "hi", "lo", *ROW, "start", "suffixes", "weight"][: len(out)])

    more = f", hi long, lo long, {ROW_SQL}, start int, suffixes int, weight long" if digests else ""
    return map_arrow(docs.select(*ROW, "text"), run, f"key long, twice boolean{more}")


# ---------------------------------------------------------------- sorting suffixes


class Suffixes:
    """Suffixes of ``data``, compared in their first LENGTH bytes by prefix hashes modulo a prime."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.prefix = prime_prefixes(data)
        self.power = prime_powers(len(data) + 1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, LENGTH at most, by binary search over prefix hashes."""
        known = np.zeros(len(a), np.int64)
        step = 1 << (LENGTH.bit_length() - 1)
        prime, none = U64((1 << 61) - 1), U64(0)
        # Brought to the same power: a range from a to the power of b's start, and the other way round.
        shift = np.minimum(a, b)
        raise_a, raise_b = self.power[b - shift], self.power[a - shift]
        from_a, from_b = self.prefix[a], self.prefix[b]
        while step:
            longer = np.minimum(known + step, LENGTH)
            x, y = self.prefix[a + longer], self.prefix[b + longer]
            x, y = x - from_a + np.where(x < from_a, prime, none), y - from_b + np.where(y < from_b, prime, none)
            known = np.where(times(x, raise_a) == times(y, raise_b), longer, known)
            step >>= 1
        return known

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before b; equal ones by ``ties``."""
        n = self.common(a, b)
        last = len(self.data) - 1
        x, y = self.data[np.minimum(a + n, last)], self.data[np.minimum(b + n, last)]
        return np.where(n >= LENGTH, ties, x < y)

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """``at`` (grouped: ``group`` ascends) with each group sorted: bottom-up mergesort of all groups at once."""
        at = at.copy()
        firsts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(at) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(firsts, len(at)))
        base, size = np.repeat(firsts, sizes), np.repeat(sizes, sizes)
        local = np.arange(len(at)) - base
        width = 1
        while len(at) and width < sizes.max():
            run = local // width
            lo = (run ^ 1) * width
            move = np.flatnonzero((size > width) & (lo < size))
            own, low = at[move], lo[move]
            high = np.minimum(low + width, size[move])
            left = (run[move] & 1) == 0
            a, b = low.copy(), high.copy()
            while True:
                open_ = np.flatnonzero(a < b)
                if not len(open_):
                    break
                mid = (a[open_] + b[open_]) // 2
                # Of equal suffixes those of the left run come first.
                less = self.before(at[base[move[open_]] + mid], own[open_], ~left[open_])
                a[open_] = np.where(less, mid + 1, a[open_])
                b[open_] = np.where(less, b[open_], mid)
            pair = np.minimum(run[move], run[move] ^ 1) * width
            place = base[move] + pair + (local[move] - run[move] * width) + (a - low)
            at[place] = own
            width *= 2
        return at

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the first LENGTH bytes are the same, by the bytes."""
        out = np.zeros(len(a), bool)
        if len(a):
            view = np.lib.stride_tricks.sliding_window_view(self.data, LENGTH)
            for k in range(0, len(a), 2048):
                out[k : k + 2048] = (view[a[k : k + 2048]] == view[b[k : k + 2048]]).all(1)
        return out


def key_places(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each suffix the first place of its least gram."""
    least = sliding_min(grams, WINDOW)[at]
    small = np.flatnonzero(np.isin(grams, np.unique(least)))
    lo = np.searchsorted(small, at)
    place = small[np.minimum(lo, len(small) - 1)]
    while len(wrong := np.flatnonzero(grams[place] != least)):
        lo[wrong] += 1
        place[wrong] = small[np.minimum(lo[wrong], len(small) - 1)]
    return place


def band_bytes(place: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band, start, end): the band of the distance from a suffix to its key's gram, and the bytes that all suffixes of the band share."""
    band = (place - at) // width
    start = place - band * width
    return band, start, start - width + 1 + LENGTH


def repeated(contents: list[bytes], counts: list[int], groups: list[int]) -> list[np.ndarray]:
    """For each content a mask of the suffixes whose first LENGTH bytes also start in another place of its group.

    ``groups`` ascends; content k stands for counts[k] places with the same bytes.
    """
    data = np.frombuffer(b"".join(contents), np.uint8)
    sizes = np.array([len(c) for c in contents], np.int64)
    begin = np.cumsum(sizes) - sizes
    number = sizes - LENGTH + 1
    total = int(number.sum())
    which = np.repeat(np.arange(len(contents)), number)
    at = np.arange(total) - np.repeat(np.cumsum(number) - number, number) + begin[which]
    prefix = prefix_hashes(data)
    place = key_places(gram_hashes(data, prefix), at)
    # Equal suffixes have the key's gram at the same distance and share their band's bytes; the others are not sorted.
    _, lo, hi = band_bytes(place, at, BAND)
    code = mix(range_hashes(prefix, lo, hi) + mix((place - at).astype(U64) + (np.array(groups, U64)[which] << U64(8))))
    order = np.argsort(code, kind="stable")
    near = code[order][1:] == code[order][:-1]
    order = order[np.concatenate([[False], near]) | np.concatenate([near, [False]])] if total else order
    hit = np.zeros(len(data), bool)
    if len(order):
        s = Suffixes(data)
        part = np.concatenate([[0], np.cumsum(code[order][1:] != code[order][:-1])])
        ordered = s.sort(at[order], part)
        pairs = np.flatnonzero(part[1:] == part[:-1])
        same = np.zeros(len(order) - 1, bool)
        same[pairs] = s.common(ordered[:-1][pairs], ordered[1:][pairs]) >= LENGTH
        claimed = np.flatnonzero(same)
        if not s.verified(ordered[claimed], ordered[claimed + 1]).all():  # a collision of hashes
            ordered = np.array([x for _, x in sorted(zip(part.tolist(), ordered.tolist(), strict=True), key=lambda t: (t[0], data[t[1] : t[1] + LENGTH].tobytes()))], np.int64)
            same[:] = False
            same[pairs] = s.verified(ordered[:-1][pairs], ordered[1:][pairs])
        hit[ordered[:-1][same]] = True
        hit[ordered[1:][same]] = True
    return [hit[b : b + n] if c == 1 else np.ones(n, bool) for b, n, c in zip(begin, number, counts, strict=True)]


# ---------------------------------------------------------------- groups

SPANS = pa.schema([("id_key", pa.int64()), ("no_id", pa.bool_()), ("text_key", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
SPANS_SQL = f"{ROW_SQL}, start int, end int"


def _edges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flip = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(flip > 0), np.flatnonzero(flip < 0)


def sorted_spans(contents: DataFrame) -> DataFrame:
    """Spans from (key, *ROW, start, weight, bytes), whole groups of a key together, each of GROUP_LIMIT contents at most."""

    def flush(rows):
        groups, seen = [], {}
        for r in rows:
            groups.append(seen.setdefault(r[0], len(seen)))
        out = []
        for r, mask in zip(rows, repeated([r[6] for r in rows], [r[5] for r in rows], groups), strict=True):
            if r[5] == 1:
                out += [(*r[1:4], r[4] + a, r[4] + b + LENGTH - 1) for a, b in zip(*(e.tolist() for e in _edges(mask)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(SPANS)], schema=SPANS)

    def run(batches):
        held, size, key = [], 0, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                small = batch.slice(lo, 2048)
                for r in zip(*(small.column(k).to_pylist() for k in range(7)), strict=True):
                    if r[0] != key and size >= GROUP_BYTES:
                        yield flush(held)
                        held, size = [], 0
                    key = r[0]
                    held.append(r)
                    size += len(r[6])
        if held:
            yield flush(held)

    n = shuffle_partitions(contents.sparkSession)
    rows = contents.select("key", *ROW, "start", "weight", "bytes").repartition(n, "key").sortWithinPartitions("key")
    return map_arrow(rows, run, SPANS_SQL)


def fetched(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """``contents`` (key, *ROW, start, suffixes, weight) with their bytes, by one join with the texts."""
    # A document has no more runs than bytes.
    by_doc = contents.groupBy(*ROW).agg(F.collect_list(F.struct("key", "start", "suffixes", "weight")).alias("runs"))
    rows = may_hold(docs.select(*ROW, "text"), contents).join(by_doc, list(ROW)).select(*ROW, "runs", F.col("text").cast("binary").alias("body"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(c)[k].as_py() for c in range(5)]
                for lo in range(0, len(row[3]), 4096):
                    some = row[3][lo : lo + 4096]
                    body = [row[4][r["start"] : r["start"] + r["suffixes"] + LENGTH - 1] for r in some]
                    same = [pa.array([v] * len(some), t) for v, t in zip(row[:3], (pa.int64(), pa.bool_(), pa.int64()), strict=True)]
                    own = [pa.array([r[n] for r in some], t) for n, t in (("key", pa.int64()), ("start", pa.int32()), ("suffixes", pa.int32()), ("weight", pa.int64()))]
                    yield pa.RecordBatch.from_arrays([own[0], *same, *own[1:], pa.array(body, pa.binary())], names=["key", *ROW, "start", "suffixes", "weight", "bytes"])

    return map_arrow(rows, run, f"key long, {ROW_SQL}, start int, suffixes int, weight long, bytes binary")


def split_contents(contents: DataFrame, width: int) -> DataFrame:
    """Runs, as in ``run_table``, of pieces of ``contents`` (with bytes): a piece for each band of distances, ``width`` wide, to
    the key's gram; its key is made of the old one, the band and the bytes that all suffixes of the band share."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                out = []
                for key, id_key, no_id, text_key, start, suffixes, weight, body in zip(*(batch.column(k).slice(lo, 1024).to_pylist() for k in range(8)), strict=True):
                    data = np.frombuffer(body, np.uint8)
                    at = np.arange(suffixes)
                    place = key_places(gram_hashes(data, prefix_hashes(data)), at)
                    band, begin, end = band_bytes(place, at, width)
                    first = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(band) != 0)]))
                    for a, b in zip(first.tolist(), [*first[1:].tolist(), suffixes], strict=True):
                        label = key.to_bytes(8, "little", signed=True) + int(band[a]).to_bytes(2, "little") + body[int(begin[a]) : int(end[a])]
                        name = int.from_bytes(hashlib.blake2b(label, digest_size=8).digest(), "little", signed=True)
                        code = _digest(body[a : b + LENGTH - 1])
                        out.append((name, False, int.from_bytes(code[:8], "little", signed=True), int.from_bytes(code[8:], "little", signed=True), id_key, no_id, text_key, start + a, b - a, weight))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), RUN_TYPES, strict=True)], names=["key", "twice", "hi", "lo", *ROW, "start", "suffixes", "weight"])

    return map_arrow(contents, run, f"key long, twice boolean, hi long, lo long, {ROW_SQL}, start int, suffixes int, weight long")


RUN_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]


def repeated_spans(docs: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(*ROW, start, end): byte ranges to remove, which may overlap, of ``keyed`` documents."""
    keys = run_table(docs, digests=False).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"))
    keys = materialize(keys.where("n > 1 OR twice"), "op2-keys")
    # Runs of a frequent key are many, but narrow; a skewed join splits them.
    shared = materialize(run_table(docs).join(keys.select("key"), "key", "left_semi"), "op2-runs")
    discard(keys)

    out = None
    same = ["key", "hi", "lo"]
    for width in (*SPLIT_BANDS, None):
        contents = shared.groupBy(*same).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.min(F.struct(*ROW, "start", "suffixes")).alias("ref"))
        contents = materialize(contents, "op2-contents")
        total = max(shared.count(), 1000)
        # Places that weigh more than one were removed as a whole before.
        whole = lookup(shared.where("weight = 1"), contents.where("weight > 1").select(*same), same, contents.where(F.col("n") * 1000 >= total).select(*same))
        whole = materialize(whole.select(*ROW, "start", (F.col("start") + F.col("suffixes") + (LENGTH - 1)).alias("end")), "op2-whole")
        discard(shared)  # the largest table; only texts and contents are needed from here on
        groups = contents.groupBy("key").agg(F.count(F.lit(1)).alias("distinct"), F.min("weight").alias("least"), F.max("twice").alias("any_twice"))
        groups = materialize(groups.where("least = 1 AND (distinct > 1 OR any_twice)").select("key", "distinct"), "op2-groups")
        often = groups.where(F.col("distinct") * 1000 >= max(contents.count(), 1000)).select("key")
        wanted = lookup(contents.select("key", "weight", "ref"), groups, ["key"], often).select("key", "distinct", "weight", "ref.*")
        few = sorted_spans(fetched(docs, wanted.where(F.col("distinct") <= group_limit)))
        # Spans of a document's runs are many and narrow; what the groups gave is written once.
        found = materialize(whole.unionByName(few), "op2-spans")
        discard(whole)
        out = found if out is None else out.unionByName(found)
        large = groups.where(F.col("distinct") > group_limit)
        if width is None or large.isEmpty():
            break
        shared = materialize(split_contents(fetched(docs, wanted.where(F.col("distinct") > group_limit)), width), "op2-runs")
        discard(contents, groups)
    discard(contents, groups)
    return out


REMOVED = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _removed(body: bytes, spans, with_text: bool) -> tuple:
    kept, text, at, removed, count = [], [], 0, 0, 0
    mark = np.zeros(len(body) + 1, np.int32)
    for s in spans or ():
        mark[s["start"]] += 1
        mark[s["end"]] -= 1
    a, b = _edges(np.cumsum(mark[:-1]) > 0) if spans else ((), ())
    for x, y in zip(map(int, a), map(int, b), strict=True):
        kept.append(body[at:x])
        removed, count = removed + y - x, count + 1
        if with_text:  # a character of which a byte stays is kept whole
            while x < y and body[x] & 0xC0 == 0x80:
                x += 1
            last = y
            if y < len(body) and body[y] & 0xC0 == 0x80:
                last = y - 1
                while last > x and body[last] & 0xC0 == 0x80:
                    last -= 1
            text.append((x, max(last, x)))
        at = y
    kept.append(body[at:])
    out = None
    if with_text:
        pieces, at = [], 0
        for x, y in text:
            pieces.append(body[at:x])
            at = y
        out = b"".join([*pieces, body[at:]]).decode("utf-8", "replace")
    return len(body), removed, count, hashlib.sha256(b"".join(kept)).hexdigest(), out


def remove_repeated(docs: DataFrame, with_text: bool = False, group_limit: int = GROUP_LIMIT, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id with n_bytes, n_removed, n_spans and kept_sha256; ``with_text`` adds kept_text, the text that is left.

    The digest is of the remaining bytes. In kept_text a character stays whole if any of its bytes does; a
    null text stays null. ``carry`` names columns to hand through, in a struct ``carried``.
    """
    carried = F.struct(F.col("text").isNull().alias("_null"), *carry)
    rows = keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), carried.alias("carried")))
    found = repeated_spans(rows.select(*ROW, "text"), group_limit)
    spans = found.groupBy(*ROW).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = rows.join(spans, list(ROW), "left").select("doc_id", "text", "spans", "carried")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                small = batch.slice(lo, 256)
                found = [_removed(t.encode(), s, with_text) for t, s in zip(small.column(1).to_pylist(), small.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([small.column(0), small.column(3), *(pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), REMOVED, strict=True))], names=["doc_id", "carried", *REMOVED.names])

    out = map_arrow(joined, run, f"doc_id long, carried {rows.schema['carried'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    if not with_text:
        return out.drop("carried", "kept_text")
    return out.withColumn("kept_text", F.when(~F.col("carried._null"), F.col("kept_text")))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document what is removed from and left of it; awkward rows as in the module's header."""
    return remove_repeated(read_table(spark, sf_dir, "documents"))
