"""Operators 11 to 13 against brute force."""

import collections
import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from voxlake.functions.scratch import scratch_path
from voxlake.llm import common, filter_audit, periodic, sharding
from voxlake.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, at):
    spark.createDataFrame([(d, t, lang, "hot", len(t or "")) for d, t, lang in rows], DOCS).repartition(4).write.mode("overwrite").parquet(f"{at}/documents.parquet")
    return str(at)


# ---------------------------------------------------------------- 11


def test_sharding(spark, small):
    got = sharding.op11_sharding(spark, small).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(got) == len(docs)
    held, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        data = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "bytes" and r["grown_shard"] is None
        held[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(held) <= set(range(24))
    assert max(held.values()) <= max(sum(held.values()) / 24 * 1.02, max(r["size"] for r in got))


def test_hot_ids_are_spread(spark):
    rows = [(None, "x" * 100)] * 3000 + [(7, "y" * 100)] * 3000 + [(k, "z" * 100) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sharding.shard(docs, scratch_path(spark, "map")).collect()
    held = collections.Counter(r["shard"] for r in got)
    assert len(got) == 9000 and max(held.values()) - min(held.values()) <= 2


def test_maps(spark):
    rng = np.random.default_rng(3)
    load = (rng.pareto(1.2, 4096) * 1000).astype(np.int64).clip(0, 300_000)
    first = sharding.SlotMap.first()
    level = first.rebalanced(load)
    share = load.sum() / 24
    assert level.fill(load).sum() == load.sum() and np.abs(level.fill(load) - share).max() <= 0.01 * share
    more = level.grown(load)
    moved = more.owner != level.owner
    assert set(more.owner[moved]) == {24} and moved.mean() < 0.15
    assert abs(more.fill(load)[24] - load.sum() / 25) < 0.05 * share
    # Rebalanced again, a balanced map hardly moves.
    assert (level.rebalanced(load).owner != level.owner).mean() < 0.2
    path = scratch_path(spark, "map")
    for new, old in ((first, None), (level, first), (more, level)):
        sharding.append_edits(spark, path, new, old)
    for m in (first, level, more):
        assert {r["virtual_slot"]: r["shard"] for r in sharding.map_at(spark, path, m.version).collect()} == dict(enumerate(m.owner.tolist()))
    whole = np.array([10**9, *[1] * 4095])
    assert sorted(first.rebalanced(whole).fill(whole))[-1] <= 10**9 + 10**6  # one slot above a share


# ---------------------------------------------------------------- 12


def test_merges():
    rng = random.Random(5)
    for _ in range(300):
        lists = [sorted(rng.sample(range(200), rng.randrange(0, 120))) for _ in range(rng.randrange(0, 6))]
        assert filter_audit.union(lists) == sorted(set().union(*lists))
        a, b = (sorted(rng.sample(range(300), rng.randrange(0, 200))) for _ in range(2))
        assert filter_audit.difference(a, b) == sorted(set(a) - set(b))
    for ids in ([], [3], list(range(0, 1000, 7))):
        for value in (0, 3, 4, 500, 2000):
            for lo in (0, min(1, len(ids)), len(ids) // 2):
                want = next((k for k in range(lo, len(ids)) if ids[k] >= value), len(ids))
                assert filter_audit.gallop(ids, value, lo) == want


def audit_by_hand(rows, labels):
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    fails = []
    for d, t, lang in rows:
        t = t or ""
        w = t.encode().split()
        own = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and least[t] < d}
        fails.append((lang or "", {k for k, v in own.items() if v}, d in good, d in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        shapley = collections.Counter()
        mine = [f for f in fails if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                removed = [f for f in mine if x in f[1] and not f[1] & before]
                shapley[x] += len(removed)
                out[part, "".join(order), k + 1] = [sum(not f[1] & set(order[: k + 1]) for f in mine), len(removed), sum(x in f[1] and bool(f[1] & before) for f in mine), sum(f[1] == {x} for f in mine), sum(f[2] for f in removed), sum(f[3] for f in removed), x]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_by_hand(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)] + ["LOUD", "Ab#c", "x|y", "é", "日本"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 90, 100, 130, 400]))), rng.choice(["en", "de", None])) for k in range(120)]
    rows += [(200 + k, rows[rng.randrange(20)][1], rng.choice(["en", None])) for k in range(60)]
    rows += [(None, rows[0][1], "en"), (None, None, None), (5, None, "en"), (6, "", "fr"), (6, "", "fr"), (900, rows[1][1].upper(), "de"), (901, ("same words " * 9)[:-1] + "\x1c", "de"), (902, "AB CDE", "xx")]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 260, 3)] + [(6, 1, 0), (6, 0, 1), (None, 1, 1), (902, None, 1)]
    at = table(spark, rows, tmp_path)
    spark.createDataFrame([(d, q, int(t)) for d, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    got = QUERIES["op12_filter_audit"](spark, at).collect()
    want = audit_by_hand(rows, labels)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got} == want and len(got) == len(want)


def test_filter_audit_sql(spark, small):
    assert_same(QUERIES["op12_filter_audit"](spark, small), connect(small), SQL["op12_filter_audit"])


def test_long_texts_are_counted_in_pieces():
    text = b" ".join(b"w%d" % (k % 5000) for k in range(400_000))
    assert b"".join(common.pieces(text, 1000)) == text and sum(len(p.split()) for p in common.pieces(text, 1000)) == 400_000
    assert filter_audit.measure(text)[:4] == (False, True, False, False) and list(common.pieces(b"")) == []


# ---------------------------------------------------------------- 13


def runs_by_hand(w):
    n, best = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                best.setdefault((i, j + p - i), p)
            i = j
    return sorted((s, n, p) for (s, n), p in best.items())


def test_difference_cover():
    assert {(a - b) % periodic.V for a in periodic.COVER for b in periodic.COVER} == set(range(periodic.V))


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_extensions(letters):
    rng = np.random.default_rng(letters)
    w = rng.integers(1, letters + 1, 500).astype(np.int32)
    w[200:420] = np.tile(w[200:211], 20)
    w = np.append(w, 99).astype(np.int32)
    ext = periodic.Extensions(w)
    i, j = (rng.integers(0, len(w), 4000) for _ in range(2))
    i, j = i[i != j], j[i != j]
    for a, b, got in zip(i.tolist(), j.tolist(), ext.lce(i, j).tolist(), strict=True):
        k = 0
        while a + k < len(w) and b + k < len(w) and w[a + k] == w[b + k]:
            k += 1
        assert got == k


def texts_with_runs():
    rng = random.Random(4)
    out = ["", " \n", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3 + "a", "a b c " * 30, "a a a a a a b " * 5, "x " * 400, "A a " * 9]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            unit = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 9, 30]))]
            parts += unit * rng.choice([1, 3, 4, 5, 7]) + unit[: rng.randrange(len(unit))] + [f"u{rng.random()}"] * rng.randrange(2)
        out.append(" ".join(parts))
    out += [" ".join(rng.choice("ab") for _ in range(n)) for n in (30, 100, 333)]
    out.append(" ".join(f"w{k % 997}" for k in range(7000)) + "\x0b\x85end")
    return out


def test_runs_of_a_slice():
    docs = [t.encode().split() for t in texts_with_runs()]
    numbers = periodic._Numbers()
    coded = [periodic.numbered(t.encode(), numbers) for t in texts_with_runs()]
    found = periodic.slice_runs(coded, len(numbers) + 1)
    for w, rows in zip(docs, found, strict=True):
        assert [tuple(r) for r in rows.tolist()] == runs_by_hand(w)


def test_periodic_runs(spark, tmp_path):
    texts = [*texts_with_runs(), None]
    rows = [(k, t, "en") for k, t in enumerate(texts * 2)] + [(None, "a b " * 20, None), (3, texts[30], "en"), (3, texts[30], "en")]
    got = QUERIES["op13_periodic_runs"](spark, table(spark, rows, tmp_path)).collect()
    assert len(got) == len(rows)
    seen = collections.Counter(tuple(r) for r in got)
    want = collections.Counter()
    edited = 0
    for d, t, _ in rows:
        w = (t or "").encode().split()
        n, h = len(w), zlib.crc32(str(d).encode())
        g = h // 10
        if d is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            edited += 1
        found = runs_by_hand(w)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        want[(d, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())] += 1
    assert edited > 5 and seen == want


def test_whole_table_of_runs(spark, small):
    """Every document of the smallest table, against the definition."""
    got = {r["doc_id"]: r for r in periodic.find_runs(spark.read.parquet(f"{small}/documents.parquet"), periodic.repeats_planted).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").where(F.length("text") < 6000).collect():
        w = r["text"].encode().split()
        index = periodic.repeats_planted(r["doc_id"], len(w)) if w else None
        w = w if index is None else [w[i] for i in index]
        assert [tuple(x) for x in got[r["doc_id"]]["runs"]] == runs_by_hand(w)
