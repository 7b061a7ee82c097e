"""The corpus operators against brute force, on small tables with every awkward row."""

import collections
import hashlib
import itertools
import math
import random
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

import corpus_pipeline
from voxlake.llm import chat, common, fingerprints, langid, minhash, mixing, packing, quality_rank, quality_rules, suffix_dedup, url_filter
from voxlake.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '', ',', '.'])}{rng.choice(['', '', chr(10)])}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    passage = prose(rng, 60)
    base = prose(rng, 120)
    words = base.split(" ")
    out = [None, "", " \n ", "é", "one two", "Ünïcödé wörds añd 日本語 🎉", "a" * 900, "ab" * 500, base, base, base.upper(), "x y z " * 200]
    out += [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in range(0, 100, 9)]
    out += [" ".join([*words[:k], "one", *words[k + 1 : k + 40], "two", *words[k + 41 :], "tail"]) for k in range(0, 60, 7)]
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 20) for _ in range(4)]
    out += [prose(rng, rng.randrange(1, 200)) for _ in range(20)] + [prose(rng, 6000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k * 3 + 1, t, "en" if k % 3 else None, "hot" if k % 2 else f"s{k}", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(docs):
    """Extra columns whose names the operators use themselves."""
    names = ["score", "lang_pred", "n_words", "predicted", "host", "path", "rule", "verdict", "weight", "key", "rep", "spans"]
    return docs.select("*", *(F.lit(1).alias(n) for n in names))


# ---------------------------------------------------------------- 1


def shingles_of(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def write_tables(spark, path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def test_fingerprints(spark, docs, texts, tmp_path):
    """The query against definitions that share no code with it: texts, digests, exact Jaccard and bottom-k by hand."""
    import base64

    got = by_id(QUERIES["op1_fingerprints"](spark, write_tables(spark, tmp_path, documents=clashing(docs))))
    order = sorted(((k * 3 + 1, t or "") for k, t in enumerate(texts)), reverse=True)
    assert len(got) == len(order)
    sketch = {}
    for (doc, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = got[doc]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, nxt = map(shingles_of, (text, edited, after))
        for near, x in ((row["near_edited"], other), (row["near_next"], nxt)):
            assert 0 <= near <= 1 and abs(near - jaccard(own, x)) < (0.12 if len(own | x) > 256 else 1e-9)
        assert abs(row["next_contained"] - (len(own & nxt) / len(nxt) if nxt else 1.0)) < (0.15 if len(own | nxt) > 256 else 1e-9)
        values = np.frombuffer(base64.b64decode(row["fingerprint"]), "<u8")
        assert len(values) == min(len(own), 256) and (np.diff(values.astype(float)) > 0).all()
        if len(own) <= 256:
            sketch.setdefault(frozenset(own), row["fingerprint"])
            assert sketch[frozenset(own)] == row["fingerprint"]
        # A sketch has the least hashes of the whole text's shingles, so a part's least ones that are below its last are in it.
        part = np.frombuffer(base64.b64decode(row["edited_fingerprint"]), "<u8")
        if own <= other and len(part):
            assert set(values[values <= part[-1]]) <= set(part)
    assert fingerprints.fingerprint_edits(empty(spark)).count() == 0


def test_fingerprints_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "z y x w v u"), (None, "n"), (None, None), (7, "g h i j k l m")]
    frame = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS).repartition(3)
    got = fingerprints.fingerprint_edits(frame).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((d is None, d or 0, len(t or "")) for d, t in rows)
    prints = collections.defaultdict(set)
    for r in got:
        prints[r["doc_id"], r["n_chars"]].add(r["fingerprint"])
    assert len(prints[1, 11]) == 2
    alone = fingerprints.fingerprint_edits(frame.where("doc_id = 7")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"g h i jg h i ").hexdigest()


def test_sketches_of_groups_merge_across_parts(spark, docs, texts):
    got = {r["group"]: r for r in fingerprints.merged_sketches(docs, "source").collect()}
    sets = collections.defaultdict(set)
    for k, t in enumerate(texts):
        sets["hot" if k % 2 else f"s{k}"] |= shingles_of(t)
    assert set(got) == set(sets)
    for name, shingles in sets.items():
        assert abs(got[name]["distinct_shingles"] - len(shingles)) <= (0 if len(shingles) < 256 else 0.25 * len(shingles))
    (whole,) = fingerprints.sketches([" ".join(t for k, t in enumerate(texts) if k % 2 and t)])
    assert fingerprints.resemblance(fingerprints.decode(got["hot"]["sketch"]), whole) > 0.9
    assert fingerprints.merged_sketches(empty(spark), "source").count() == 0


def test_sketches_merge_and_estimate():
    rng = random.Random(3)
    a, b = prose(rng, 3000, 5000), prose(rng, 3000, 5000)
    whole, one, two = fingerprints.sketches([a + " " + b, a, b])
    # Only the four shingles across the seam are in the whole alone.
    assert fingerprints.resemblance(fingerprints.merge(one, two), whole) > 0.97
    assert abs(fingerprints.distinct_count(one) / 2996 - 1) < 0.2
    assert fingerprints.containment(one, whole) > 0.85
    assert fingerprints.resemblance(*fingerprints.sketches(["", None])) == 1.0
    assert (fingerprints.decode(fingerprints.encode(one)) == one).all()


# ---------------------------------------------------------------- 2


def removed_by_brute_force(texts, length=200):
    count = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                hit[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if hit[k] and (not k or not hit[k - 1]))
        out.append((len(t), sum(hit), spans, hashlib.sha256(bytes(c for c, h in zip(t, hit, strict=True) if not h)).hexdigest()))
    return out


def test_suffix_dedup_query(spark, docs, texts, tmp_path):
    got = by_id(QUERIES["op2_suffix_dedup"](spark, write_tables(spark, tmp_path, documents=clashing(docs))))
    want = removed_by_brute_force([(t or "").encode() for t in texts])
    assert {d: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for d, r in got.items()} == {k * 3 + 1: w for k, w in enumerate(want)}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for k in range(files.size()) if (n := files.apply(k).getName()).startswith("shuffle_")}


def test_scratch_tables_leave_no_shuffle_files(spark):
    before, name = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    conf = spark.conf.get(name)
    table = common.materialize(spark.range(20_000).groupBy((F.col("id") % 997).alias("k")).count(), "test")
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and table.count() == 997 and spark.conf.get(name) == conf


def test_texts_that_join_with_nothing_are_not_shuffled(spark):
    rows = common.keyed(spark.createDataFrame([(d, f"text {d}") for d in [None, *range(3000)]], "doc_id long, text string"))
    wanted = rows.where("no_id OR id_key % 100 = 7").select(*common.ROW)
    got = common.may_hold(rows, wanted)
    assert got.columns == rows.columns and got.join(wanted, list(common.ROW), "left_semi").count() == 31
    assert got.count() < 40 and common.may_hold(rows, wanted.limit(0)).count() == 0


def thue_morse_pair():
    """Two texts of 65,536 bytes that share no 200 bytes, but whose polynomial hashes modulo 2**64 are the same."""
    rng = random.Random(11)
    gram = "".join(rng.choice("ghijklmn") for _ in range(32))
    turn = [bin(k).count("1") & 1 for k in range(1024)]
    blocks = [gram + "".join(rng.choice("opqrstuv") for _ in range(31)) for _ in turn]
    return ["".join(b + "ab"[t ^ flip] for b, t in zip(blocks, turn, strict=True)) for flip in (0, 1)]


def test_equal_hashes_of_unequal_texts_remove_nothing(spark):
    pair = thue_morse_pair()
    one, two = (common.prefix_hashes(np.frombuffer(t.encode(), np.uint8))[-1] for t in pair)
    assert pair[0] != pair[1] and one == two
    got = suffix_dedup.remove_repeated(spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in got] == [0, 0]


def test_a_hot_line_is_split_over_groups(spark):
    """3,000 documents share a line of 150 bytes in contexts of their own; two of them also share what surrounds it."""
    rng = random.Random(12)
    line = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = [(d, f"{rng.getrandbits(400):0100x}{line}{rng.getrandbits(400):0100x}") for d in range(3000)]
    rows += [(9000, "x" * 10 + rows[5][1][60:290] + "y" * 40), (9001, rows[5][1][:80] + "z")]
    got = by_id(suffix_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    removed = {d: r["n_removed"] for d, r in got.items() if r["n_removed"]}
    assert removed == {5: 230, 9000: 230}


def test_long_and_periodic_texts(spark):
    """Texts longer than a slice, taken in pieces: a passage across the seam, and a period of three."""
    rng = random.Random(13)
    noise = "".join(rng.choice("abcdefghijklmnop") for _ in range(common.SLICE_BYTES + 5000))
    seam = noise[common.SLICE_BYTES - 300 : common.SLICE_BYTES + 300]
    rows = [(1, noise), (2, "q" + seam + "r"), (3, "xyz" * 400_000), (4, "xyz" * 80), (5, "xyz" * 60)]
    got = by_id(suffix_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(got[d]["n_removed"], got[d]["n_spans"]) for d in range(1, 6)] == [(600, 1), (600, 1), (1_200_000, 1), (240, 1), (0, 0)]


@pytest.mark.parametrize("limit", [2000, 1])
def test_suffix_dedup(docs, texts, limit):
    got = by_id(suffix_dedup.remove_repeated(docs, group_limit=limit))
    for k, want in enumerate(removed_by_brute_force([(t or "").encode() for t in texts])):
        assert tuple(got[k * 3 + 1][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want


def test_suffix_dedup_repeated_rows_and_empty(spark, docs):
    twice = docs.limit(12).unionByName(docs.limit(12))
    rows = suffix_dedup.remove_repeated(twice).collect()
    assert len(rows) == 24 and all(r["n_removed"] == r["n_bytes"] for r in rows if r["n_bytes"] >= 200)
    assert suffix_dedup.remove_repeated(empty(spark)).count() == 0


def test_suffix_sort_orders_suffixes():
    rng = random.Random(1)
    data = np.frombuffer(("".join(rng.choice("ab") for _ in range(3000)) + "ab" * 600).encode(), np.uint8)
    at = np.arange(len(data) - 200)
    rng.shuffle(at)
    group = np.repeat([0, 1], [len(at) // 3, len(at) - len(at) // 3])
    got = suffix_dedup.Suffixes(data).sort(at, group)
    blob = data.tobytes()
    for g in (0, 1):
        part = [blob[k : k + 200] for k in got[group == g]]
        assert part == sorted(part) and sorted(got[group == g]) == sorted(at[group == g])


def test_kept_text_has_whole_characters():
    body = "aé日b".encode()
    n, removed, spans, _, text = suffix_dedup._removed(body, [{"start": 2, "end": 5}], True)
    assert (n, removed, spans, text) == (7, 3, 1, "aé日b")
    assert suffix_dedup._removed(body, [{"start": 1, "end": 3}], True)[4] == "a日b"


# ---------------------------------------------------------------- 3


def test_chat_round_trip(spark):
    rng = random.Random(2)
    pieces = ["<|im_end|>", "<|im_start|>assistant ok", "\\", "<", "|", "<\\|", "\n", "a", "", "é", "\\\\<|"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole", "<|x", None]), rng.choice([None, *("".join(rng.choices(pieces, k=k)) for k in range(1, 9))])) for c in range(40) for t in range(rng.randrange(1, 7))]
    rows += [(99, 0, "user", "a"), (99, 0, "user", "a"), (None, 0, "user", "b"), (77, None, "assistant", "c")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1)).repartition(3)
    got = by_id(chat.read_back(chat.format_segments(frame)), "conv_id")
    groups = collections.defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append(((t is not None, t or 0), r is not None, r or "", x is not None, x or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        said = [(r, x) for _, _, r, _, x in turns]
        learned = "".join(x for r, x in said if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(said) and row["loss_chars"] == len(learned)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()


def test_chat_query_has_its_own_conversation(spark, tmp_path):
    frame = spark.createDataFrame([(4, 1, "assistant", "b"), (4, 0, "user", None)], "conv_id long, turn long, role string, text string")
    got = by_id(QUERIES["op3_chat"](spark, write_tables(spark, tmp_path, conversations=frame.withColumn("seq", F.lit(1)))), "conv_id")
    said = "<|im_end|><|im_start|>assistant ok"
    assert set(got) == {-1, 4} and got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == len(said)
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[4]["loss_chars"] == 1
    nothing = QUERIES["op3_chat"](spark, write_tables(spark, tmp_path / "none", conversations=frame.limit(0)))
    assert [r["conv_id"] for r in nothing.collect()] == [-1]


def test_a_template_with_marks_of_its_own(spark):
    own = chat.Template(open="[:turn ", close="[:end]", mark="[:", loss_roles=frozenset({"bot"}))
    rows = [(1, 0, "user", "[:end] [: \\ [\\: <|im_end|>" + "x" * 50_000), (1, 1, "bot", "[:turn bot\n[:end]")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (row,) = chat.read_back(chat.format_segments(frame, own), own).collect()
    assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert row["loss_chars"] == len(rows[1][3])
    with pytest.raises(ValueError):
        chat.Template(open="<turn>")


def test_chat_order(spark):
    frame = spark.createDataFrame([(1, k, r, "x") for k, r in enumerate(["system", "user", "assistant"])] + [(2, 0, "assistant", "x"), (2, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    got = by_id(chat.read_back(chat.format_segments(frame)), "conv_id")
    assert got[1]["in_order"] and not got[2]["in_order"]
    segments = chat.format_segments(frame).where("conv_id = 1").orderBy("seq").collect()
    assert [s["loss"] for s in segments] == [False] * 7 + [True, False]
    assert "".join(s["text"] for s in segments).startswith("<|im_start|>system\nx<|im_end|>\n<|im_start|>user")


# ---------------------------------------------------------------- 4


def test_packing(spark, docs, texts):
    pieces = packing.tokenize_pieces(docs)
    rows = packing.pack(common.materialize(pieces, "t")).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for k, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((k * 3 + 1, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(b))]
        assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 2048
    assert packing.pack(packing.tokenize_pieces(empty(spark))).count() == 0


def test_plan_is_close_to_the_bound():
    rng = random.Random(5)
    for _ in range(40):
        h = {n: rng.choice([1, 3, 1000]) for n in rng.sample(range(1, 2049), 300)}
        steps, opened = packing.plan(h)
        placed = collections.Counter()
        for s in steps:
            placed[s.length] += s.bins * s.each
        assert placed == h and opened >= sum(n * c for n, c in h.items()) / 2048
        large = sum(c for n, c in h.items() if 3 * n > 2048)
        assert opened <= max(large, 1.1 * sum(n * c for n, c in h.items()) / 2048 + 2)
    with pytest.raises(ValueError):
        packing.plan({3000: 1})


def test_third_at_most_twice_and_greedy():
    steps, opened = packing.plan({1000: 4, 700: 2, 100: 3})
    assert opened == 3 and max(s.each for s in steps if s.length >= 700) <= 2


# ---------------------------------------------------------------- 5


def test_mixing_meets_the_margins(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, rng.choice([20, 150, 700])), rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "a", "b"]), 0) for k in range(300)] + [(900, None, "en", "a", 0), (901, "", "en", "a", 0)]
    frame = spark.createDataFrame(rows, DOCS)
    described = common.materialize(mixing.described(frame), "t")
    cells = common.materialize(mixing.rake(mixing.cell_sizes(described)), "t")
    pdf = cells.toPandas()
    assert abs(pdf["weight"].sum() - 1) < 1e-6 and pdf["probability"].max() == 1.0
    for name, power in zip(mixing.DIMENSIONS, mixing.Settings().powers, strict=True):
        own = pdf.groupby(name)["tokens"].sum() ** power
        assert np.allclose(pdf.groupby(name)["weight"].sum(), own / own.sum(), atol=1e-3)
    out = by_id(mixing.assign(described, cells))
    assert len(out) == 302 and not out[900]["sampled"] and not out[901]["sampled"]
    assert mixing.mix_stage(spark, empty(spark), "").count() == 0
    kept = mixing.mix_stage(spark, clashing(frame), "")
    assert kept.columns == clashing(frame).columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in out.items() if r["sampled"]}


# ---------------------------------------------------------------- 6


def statistics_by_brute_force(text):
    text = text or ""
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark, texts):
    odd = [*texts, "a # b\n\na # b\n | | ", "\u00a0x\u2028y\x1cz", "same line\nsame line\nsame line", "r s t u v w x y z " * 3]
    frame = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").withColumn("n_words", F.lit(5))
    got = by_id(quality_rules.text_statistics(frame))
    for k, t in enumerate(odd):
        assert tuple(got[k][c] for c in quality_rules.STATISTICS[:5]) == statistics_by_brute_force(t)


def test_exact_binomial_bound():
    assert abs(quality_rules.upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9
    assert quality_rules.upper_bound(5, 5, 0.1) == quality_rules.upper_bound(0, 0, 0.1) == 1.0
    assert quality_rules.upper_bound(3, 50, 0.01) > quality_rules.upper_bound(3, 50, 0.1) > 3 / 50


def test_cutoffs_keep_their_promise(spark):
    rng = random.Random(9)
    rows = [(k, "big" if k < 3000 else "few", 100, 400, int(400 * rng.betavariate(1, 60)), 0, 0, 10, 0) for k in range(3040)]
    frame = spark.createDataFrame(rows, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in quality_rules.STATISTICS))
    cutoffs = quality_rules.select_cutoffs(frame, "stratum")
    assert not any(s == "few" for _, s in cutoffs) and ("symbols", "big") in cutoffs
    rejected = frame.where(~quality_rules.passes(cutoffs, F.col("stratum"))).count()
    assert 0 < rejected <= quality_rules.Settings().alpha * 3000 and cutoffs["dup_lines", "big"] == 0.01
    assert quality_rules.select_cutoffs(frame.limit(0), "stratum") == {}


def test_kept_by_brute_force(spark, tmp_path):
    """2,400 labelled documents, symbols in a few: cutoffs appear, and the query keeps what the definition keeps."""
    rng = random.Random(21)
    rows = []
    for d in range(2500):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice([15, 40, 60, 60]))]
        words += ["#" * rng.randrange(9)] * (d % 50 == 0) + ["##||##"] * 30 * (d % 5 == 4)
        rows.append((d, " ".join(w for w in words if w), ["en", "en", "en", "de", None][rng.randrange(5)] if d % 7 else "en"))
    rows += [rows[3], rows[3], (5000, None, "en"), (5001, "", "xx"), (None, "a " * 40, "en")]
    labels = [(d, int(d % 5 != 4), 0) for d in range(2400)] + [(7, 1, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("stratum", F.lit(1))
    path = write_tables(spark, tmp_path, documents=frame, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = QUERIES["op6_quality_rules"](spark, path).collect()
    stats = {}
    for d, t, lang in rows:
        n, chars, symbols, dup, repeat = statistics_by_brute_force(t)
        lines = len([x for x in (t or "").split("\n") if x.strip()])
        stats[d, t] = (n < 20 or 100 * repeat > 30 * n, lang or "und", [symbols / max(chars, 1), dup / max(lines, 1), repeat / max(n, 1), (t or "").count("!") / max(n, 1)], n)
    good = {d for d, q, _ in labels if q == 1}
    strata = collections.defaultdict(list)
    for d, t, _ in rows:
        failed, lang, features, _ = stats[d, t]
        if d in good and not failed:
            strata[lang].append(features)
    s, cut = quality_rules.Settings(), {}
    for lang, of in strata.items():
        for rule in range(4):
            for c in s.grid:
                hits, n = sum(f[rule] > c for f in of), len(of)
                # The exact bound is at most alpha / 4 if so few hits are unlikely enough at that share.
                p = s.alpha / 4
                tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(hits + 1))
                if hits > p * n or tail > s.delta / (4 * len(strata)):
                    break
                cut[lang, rule] = c
    assert cut and len({lang for lang, _ in cut}) < len(strata)
    want = sorted((d is None, d or 0, n, not failed and all(f[r] <= cut.get((lang, r), 9) for r in range(4))) for d, t, _ in rows for failed, lang, f, n in [stats[d, t]])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["kept"]) for r in got) == want
    assert any(not k and n >= 20 for _, _, n, k in want) and sum(k for *_, k in want) > 500
    none = write_tables(spark, tmp_path / "none", documents=frame.limit(0), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert QUERIES["op6_quality_rules"](spark, none).count() == 0


# ---------------------------------------------------------------- 7


def groups_by_brute_force(rows, percent=85):
    """(doc_id, set size, component_id) of every row, rows told apart by place."""
    sets = [shingles_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    least = {}
    for k, (d, _) in enumerate(rows):
        ids = [i for i in (least.get(find(k)), d) if i is not None]
        least[find(k)] = min(ids) if ids else None
    return [(d, len(sets[k]), least[find(k)]) for k, (d, _) in enumerate(rows)]


def components_by_brute_force(rows, percent=85):
    return {d: (n, c, d == c) for d, n, c in groups_by_brute_force(rows, percent)}


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_near_duplicates_of_repeated_and_null_ids(spark):
    """Rows of one doc_id with unlike texts keep their links; rows without an id take part."""
    words = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (1, "quite another text than that one"), (2, " ".join([*words, "z"])), (3, "quite another text than that one")]
    rows += [(2, " ".join([*words, "z"])), (None, " ".join(words[1:])), (None, "one two three four five six"), (None, None), (4, ""), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(frame).collect()
    assert ordered((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == ordered(groups_by_brute_force(rows))
    kept = minhash.near_duplicate_stage(spark, frame.withColumn("text_key", F.lit(1)), "")
    assert kept.columns == ["doc_id", "text", "text_key"]
    # One of each group: the first text, the other one, the null id's own, and the texts without words.
    assert ordered((r["doc_id"], len(r["text"] or "")) for r in kept.collect()) == ordered([(1, len(rows[0][1])), (1, len(rows[1][1])), (None, len(rows[6][1])), (None, 0), (4, 0)])


def test_recall_of_planted_pairs(spark, small):
    """Pairs of 0.85 to 0.90, planted into a whole table: none is missed."""
    rng = random.Random(31)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    pairs = []
    for k in range(150):
        words = [f"v{k}x{j}" for j in range(rng.randrange(120, 400))]
        other = list(words)
        while jaccard(shingles_of(" ".join(words)), shingles_of(" ".join(other))) > 0.9:
            other[rng.randrange(len(other))] = f"u{rng.random()}"
        if jaccard(shingles_of(" ".join(words)), shingles_of(" ".join(other))) >= 0.85:
            pairs += [(100_000 + 2 * k, " ".join(words)), (100_001 + 2 * k, " ".join(other))]
    assert len(pairs) > 200
    got = by_id(minhash.near_duplicates(spark.createDataFrame(docs + pairs, "doc_id long, text string")))
    assert sum(got[d]["component_id"] == d - d % 2 for d, _ in pairs) == len(pairs)


def test_signatures_of_very_large_sets():
    rng = np.random.default_rng(5)
    shared, own, other = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (1_000_000, 200_000, 200_000))
    one, two = (minhash.signature(np.concatenate([shared, x])) for x in (own, other))
    assert abs((one == two).mean() - 1 / 1.4) < 0.12
    apart = minhash.signature(rng.integers(0, 2**63, 1_200_000).astype(np.uint64))
    assert (one == apart).mean() < 0.05


def test_near_duplicates(spark, docs, texts):
    got = by_id(minhash.near_duplicates(clashing(docs)))
    want = components_by_brute_force([(k * 3 + 1, t) for k, t in enumerate(texts)])
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == want
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_near_threshold_groups_lose_no_link(spark):
    """Copies of one text, each with its own changes: some pairs are linked, many are not."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(170)]
    rows = []
    for d in range(120):
        w = list(base)
        for k in rng.sample(range(170), rng.choice([1, 2, 3, 3, 4])):
            w[k] = f"e{rng.randrange(40)}" if d % 3 else f"e{d}x{k}"
        rows.append((d, " ".join(w)))
    rows += [(1000 + d, rows[d][1] + " more") for d in range(0, 120, 10)]
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == components_by_brute_force(rows)


def test_prefix_rows_of_a_family_follow_its_size(spark, monkeypatch):
    """A family of near copies, of which most are linked: a member's rows don't grow with the number of its leaders."""
    rng = random.Random(9)
    base, rows = [f"b{k}" for k in range(150)], []
    for d in range(400):
        w = list(base)
        for k in rng.sample(range(150), rng.choice([1, 2, 3, 4, 6, 8])):
            w[k] = f"e{rng.randrange(60)}"
        rows.append((d, " ".join(w)))
    made, materialize = collections.Counter(), minhash.materialize

    def counted(df, name):
        out = materialize(df, name)
        made[name] += out.count() if name == "op7-prefix" else 0
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == components_by_brute_force(rows)
    assert made["op7-prefix"] < 40 * len(rows)


def test_tables_of_a_template_follow_its_size(spark, monkeypatch):
    """Documents that each hold most lines of a template are in many common buckets, yet few are linked: no table has a row a pair and shingle."""
    rng = random.Random(12)
    lines = [" ".join(f"t{k}w{j}" for j in range(8)) for k in range(80)]
    rows = [(d, "\n".join(lines[k] for k in sorted(rng.sample(range(80), 64)))) for d in range(140)]
    rows += [(1000 + d, rows[d][1] + f" and more of {d}") for d in range(0, 140, 7)]
    made, materialize = collections.Counter(), minhash.materialize

    def counted(df, name):
        out = materialize(df, name)
        made[name] = max(made[name], out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == components_by_brute_force(rows)
    assert max(made.values()) <= 64 * len(rows)


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(6)
    for n in (1, 40, 700, 20_000):
        shared, own, other = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (n, n // 8, n // 9))
        for bits in (minhash.SKETCH_BITS, minhash.WIDE_BITS):
            one, two = (minhash.sketch(np.concatenate([shared, x]), bits) for x in (own, other))
            assert one.dtype == np.int64 and len(one) == bits // 64
            apart = int(np.unpackbits((one ^ two).view(np.uint8)).sum())
            assert apart <= len(own) + len(other) and (apart - len(own) - len(other)) % 2 == 0


def test_near_duplicate_stage_links_from_80_percent(spark, docs, texts):
    """The stage keeps what brute force keeps at 80; the pair of 0.80 to 0.849 in it is none at 85."""
    words = [f"p{k}" for k in range(204)]
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)] + [(5000 + d, " ".join(w)) for d, w in enumerate([words, words[:50] + ["q1"] + words[51:100] + ["q2"] + words[101:150] + ["q3"] + words[151:190] + ["q4"] + words[191:]])]
    want = {percent: {d for d, (_, _, kept) in components_by_brute_force(rows, percent).items() if kept} for percent in (80, 85)}
    assert 5001 in want[85] - want[80]
    extra = spark.createDataFrame([(d, t, "en", "pair", len(t)) for d, t in rows[-2:]], DOCS)
    got = minhash.near_duplicate_stage(spark, docs.unionByName(extra), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want[80])


def test_signature_is_circulant_minhash():
    st = minhash.Settings()
    h = np.unique(np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64))
    at = (common.mix(h ^ np.uint64(st.seed)) >> np.uint64(32)).astype(np.uint32)
    sig = minhash.signature(h)

    def pi(place, shift):  # the ring stays, the place in it turns
        ring, inside = place >> 20, (place + shift) % (1 << 20)
        return int(minhash.pi(np.array([(ring << 20) | inside], np.uint32))[0, 0])

    assert [sig[k] for k in (0, 1, 100, 191)] == [min(pi(int(a), k) for a in at) for k in (0, 1, 100, 191)]
    # pi is a bijection: places of some rings have different values.
    places = np.concatenate([np.arange(r << 20, (r << 20) + 70_000, dtype=np.uint32) for r in (0, 1, 77, 4095)])
    assert len(np.unique(np.concatenate([minhash.pi(p)[:, 0] for p in np.array_split(places, 50)]))) == len(places)


# ---------------------------------------------------------------- 8


def ppm_by_hand(train, text, order=3, least=1):
    """Code length by the definition, from counts of followers."""
    counts = collections.defaultdict(collections.Counter)
    for t in train:
        for k in range(len(t)):
            for n in range(min(order, k) + 1):
                counts[t[k - n : k]][t[k]] += 1
    bits = 0.0
    for k in range(len(text)):
        for n in range(min(order, k), -1, -1):
            c = counts.get(text[k - n : k])
            if c is None or (n == 3 and sum(c.values()) < least):
                continue
            total, distinct = sum(c.values()), len(c)
            if c[text[k]]:
                bits -= np.log2(c[text[k]] / (total + distinct))
                break
            bits -= np.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    train = {"xx": [b"the cat sat on the mat", b"abracadabra"], "yy": [b"le chat noir", b"un deux trois"]}
    model = langid.Model.learn(train, min_context=1)
    text = "the chat zé abra".encode()
    got = model.code_lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    assert np.allclose(got, [ppm_by_hand(train[k], text) for k in ("xx", "yy")], rtol=1e-5)


def test_code_lengths_by_pieces_and_rows(monkeypatch):
    """Many rows, short and empty ones among them, in pieces smaller than a text; a tree cut down still gives PPM code lengths of fewer contexts."""
    rng = random.Random(6)
    train = {"xx": [bytes(rng.choice(b"abcde \n") for _ in range(900))], "yy": ["ж ѣ日本 щé".encode() * 20]}
    model = langid.Model.learn(train, min_context=3)
    rows = [bytes(rng.choice(b"abcxyz \xd0\xb6") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 40]))) for _ in range(60)]
    data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    want = np.array([[ppm_by_hand(train[k], r, least=3) for k in ("xx", "yy")] for r in rows])
    assert np.allclose(model.code_lengths(data, offsets), want, rtol=1e-5)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert np.allclose(model.code_lengths(data, offsets), want, rtol=1e-5)
    small = langid.Model.learn(train, 3, cells=400)
    assert sum(t.bits.size for t in small.trees) <= 400 < sum(t.bits.size for t in model.trees)
    assert np.isfinite(small.code_lengths(data, offsets)).all()


def test_size_of_many_languages():
    """Sixty languages of 244 bytes each stay within ``cells``, and are told apart."""
    rng = np.random.default_rng(2)
    chance = [rng.permutation(np.arange(1, 245) ** -1.2) for _ in range(60)]
    text = [rng.choice(244, 30_000, p=c / c.sum()).astype(np.uint8).tobytes() for c in chance]
    model = langid.Model.learn({f"l{k:02}": [t] for k, t in enumerate(text)}, cells=4_000_000)
    assert len(model.trees) == 60 and sum(t.bits.size for t in model.trees) <= 4_000_000
    assert all(x.nbytes < 1 << 20 for t in model.trees for x in (t.row, t.state, t.bits))
    asked = [rng.choice(244, 400, p=c / c.sum()).astype(np.uint8).tobytes() for c in chance]
    cost = model.code_lengths(np.frombuffer(b"".join(asked), np.uint8), np.arange(61) * 400)
    assert (cost.argmin(1) == np.arange(60)).mean() > 0.95


def test_language_of_awkward_texts(spark, docs):
    model = langid.learn(docs.select("doc_id", "text", "lang"))
    out = langid.predict(clashing(docs), model)
    assert out.count() == docs.count() and out.where("text IS NULL OR text IN ('', ' \n ')").where("lang_pred <> 'und' OR score <> 0").count() == 0
    assert langid.predict(empty(spark), model).count() == 0
    nothing = langid.learn(empty(spark).select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_language_held_out_accuracy(spark, small):
    out = QUERIES["op8_language"](spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, n = out.where("lang = lang_pred").count(), out.count()
    assert n > 10 and right >= 0.95 * n


# ---------------------------------------------------------------- 9


URLS = [None, "", "nothing", "http://", "http://COM/", "https://a.Example.com/en/1?x#y", "http://www.example.com/en/", "http://x.www.example.com/en/2", "http://m.net/fr/5", "http://net/es/", "http://net", "http://notnet/es/", "a://b://c/d", "http://example.com?en/", "http://example.com:80/en/", "http://..com/", "http://\n.com/a\nb"]


def test_urls_by_sql(spark):
    import duckdb

    frame = pd.DataFrame({"page_id": range(len(URLS)), "url": URLS})
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(frame.itertuples(index=False, name=None)))
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")
    assert_same(got, con, url_filter.OP9_SQL)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.where("key LIKE '%7%'").unionByName(spark.range(1).select(F.lit(None).cast("string").alias("key")))
    cascade = url_filter.Cascade(listed, universe, 40)  # a universe that is said too small makes false positives
    assert len(cascade.parts) == 1 and len(cascade.parts[0]) > 2
    assert universe.where(cascade.contains(F.col("key")) != F.col("key").like("%7%")).count() == 0
    nothing = url_filter.Cascade(universe.limit(0), universe, 10)
    assert universe.where(nothing.contains(F.col("key"))).count() == 0
    parts = url_filter.Cascade(listed, universe, 4000, part_bits=2000)
    assert len(parts.parts) > 1
    assert universe.where(parts.contains(F.col("key")) != F.col("key").like("%7%")).count() == 0


# ---------------------------------------------------------------- 10


def test_language_of_long_texts_is_learned(spark):
    """All labelled texts of one language are longer than 250,000 bytes, of the other one short."""
    rows = [(d, f"aba cab bac {d} " * 20, "short") for d in range(5)] + [(10 + d, "xyz zyx yxz " * (25_000 + d), "long") for d in range(2)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(model.langs) == ["long", "short"]
    asked = spark.createDataFrame([(1, "zyx xyz yxz"), (2, "cab aba bac")], "doc_id long, text string")
    assert {d: r["lang_pred"] for d, r in by_id(langid.predict(asked, model)).items()} == {1: "long", 2: "short"}


def test_quality_held_out(spark, small):
    out = QUERIES["op10_quality_rank"](spark, small)
    assert out.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> CAST(score >= 0.7 AS INT)").count() == 0
    labelled = out.where("held_out").join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id")
    assert labelled.where("predicted = quality").count() >= 0.9 * labelled.count()


def test_pairwise_ranking_recovers_an_order(spark, docs):
    rng = np.random.default_rng(0)
    good, bad = (np.zeros((60, quality_rank.N_FEATURES)) for _ in range(2))
    good[:, 3], bad[:, 3] = rng.normal(1, 1, 60), rng.normal(-1, 1, 60)
    model = quality_rank.Model.fit(good, bad)
    assert model.weights[3] > 0 and model.score(good).mean() > model.score(bad).mean()
    alone = quality_rank.Model.fit(good, bad[:0])
    assert set(alone.score(good)) == {0.5}
    assert quality_rank.score(clashing(docs), model).count() == docs.count()
    assert quality_rank.score(empty(spark), model).count() == 0


def test_quality_scores_do_not_depend_on_the_batch(spark, docs):
    """The same rows alone, permuted and dealt otherwise have the same scores to the last bit."""
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (50, quality_rank.N_FEATURES)), rng.normal(-1, 1, (50, quality_rank.N_FEATURES))
    model = quality_rank.Model.fit(good, bad)
    x = rng.normal(0, 1, (200, quality_rank.N_FEATURES))
    whole = model.raw(x)
    assert [model.raw(x[k : k + 1])[0] for k in range(200)] == whole.tolist()
    order = rng.permutation(200)
    assert (model.raw(x[order]) == whole[order]).all() and (np.concatenate([model.raw(p) for p in np.array_split(x, 7)]) == whole).all()
    once = {r["doc_id"]: r["score"] for r in quality_rank.score(docs, model).collect()}
    again = {r["doc_id"]: r["score"] for r in quality_rank.score(docs.orderBy(F.desc("n_chars")).repartition(3), model).collect()}
    assert once == again


def test_quality_against_the_definition(spark, docs, texts):
    """Score and verdict from features counted by hand, and the cut as the quantile of all labelled scores."""
    rng = np.random.default_rng(9)
    model = quality_rank.Model(rng.random(quality_rank.N_FEATURES), 0.5 + rng.random(quality_rank.N_FEATURES), rng.normal(0, 1, quality_rank.N_FEATURES), 0.3, 2.0, 0.7)
    got = by_id(quality_rank.score(docs, model))
    for k, t in enumerate(texts):
        data = (t or "").encode()
        f = [0.0] * quality_rank.N_FEATURES
        if data:
            words, lines = data.split(), data.split(b"\n")
            lengths = [len(w) for w in words]
            mean = sum(lengths) / max(len(words), 1)
            upper, lower = sum(65 <= b <= 90 for b in data), sum(97 <= b <= 122 for b in data)
            f[:256] = [math.sqrt(data.count(bytes([b])) / len(data)) for b in range(256)]
            f[256:] = [math.log1p(len(words)), mean, math.sqrt(sum((n - mean) ** 2 for n in lengths) / len(words)) if words else 0.0, upper / max(upper + lower, 1), len(lines) / max(len(words), 1), 1 - len(set(lines)) / len(lines), sum(data.count(c.encode()) for c in "!#$%&*<>|") / max(len(words), 1)]
        raw = sum(max(-8, min(8, (x - c) / s)) * w for x, c, s, w in zip(f, model.center, model.scale, model.weights, strict=True))
        score = 1 / (1 + math.exp(-max(-40, min(40, (raw - 0.3) / 2.0 + math.log(0.7 / 0.3)))))
        row = got[k * 3 + 1]
        assert abs(row["score"] - score) < 1e-9 and row["predicted"] == int(row["score"] >= 0.7)
    labelled = spark.createDataFrame([(q, float(v)) for q, v in zip(rng.integers(0, 2, 500).tolist(), rng.normal(0, 1, 500), strict=True)], "quality int, _raw double")
    rows = labelled.collect()
    share = sum(r["quality"] == 0 for r in rows) / 500
    sides = np.quantile([r["_raw"] for r in rows], [share - 0.01, share + 0.01])
    assert abs(quality_rank.calibrate(model, labelled).cut - sides.mean()) < 1e-12


def test_quality_cut_follows_the_share_of_all_labels(spark, tmp_path, monkeypatch):
    """A tenth of the labels is bad and the classes overlap; the sample for the fit is half and half."""
    rng = random.Random(3)
    bad = {d: d % 10 == 3 for d in range(1200)}
    rows = [(d, " ".join("BUY" if rng.random() < rng.uniform(0.1, 0.5) + 0.1 * b else f"w{rng.randrange(90)}" for _ in range(60))) for d, b in bad.items()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(not b)) for d, b in bad.items()], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    real = quality_rank.Settings
    monkeypatch.setattr(quality_rank, "Settings", lambda: real(sample_docs=60))
    got = [r for r in quality_rank.op10_quality_rank(spark, str(tmp_path)).collect() if not r["held_out"]]
    share = np.mean([bad[r["doc_id"]] for r in got])
    assert 0.05 < share < 0.15
    assert abs(np.mean([r["predicted"] == 0 for r in got]) - share) < 0.01


def test_order_statistics_are_exact(spark):
    values = [float(v) for v in np.random.default_rng(4).normal(0, 1, 3000).round(2)] + [1e6, 7.0, 7.0]
    ranks = {0, 1, 300, 1500, 2999, 3002}
    got = quality_rank.order_statistics(spark.createDataFrame([(v,) for v in values], "_raw double"), ranks, most=20, buckets=16)
    assert got == {k: sorted(values)[k] for k in ranks}


# ---------------------------------------------------------------- all


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, small, name):
    assert_same(QUERIES[name](spark, small), connect(small), SQL[name])


def test_pipeline_stages(spark, small):
    raw = spark.read.parquet(f"{small}/documents.parquet")
    docs = raw
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.materialize(stage(spark, docs, small), "t")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == raw.columns
        if name == "minhash_near_dedup":
            want = components_by_brute_force([(r["doc_id"], r["text"]) for r in before.collect()], 80)
            assert {r["doc_id"] for r in docs.collect()} == {d for d, (_, _, kept) in want.items() if kept}
        if name == "suffix_array_dedup":
            old = {r["doc_id"]: r["text"] for r in before.collect()}
            kept = dict(zip(old, removed_by_brute_force([t.encode() for t in old.values()]), strict=True))
            for r in docs.collect():
                assert r["n_chars"] == len(r["text"]) and 0 <= len(r["text"].encode()) - (kept[r["doc_id"]][0] - kept[r["doc_id"]][1]) <= 6 * kept[r["doc_id"]][2]
        if name == "mixing":
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert docs.count() > 0
