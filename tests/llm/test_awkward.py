"""Every corpus query and stage on tables of awkward rows: nulls, repeats, ties, a very long text, clashing columns, nothing at all."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxlake.llm.queries import QUERIES

#: Names that operators give to columns of their own.
CLASHES = ("score", "n_words", "kept", "rule", "weight", "probability", "sampled", "topic", "class", "salt", "text_key", "id_key", "spans", "fingerprint", "part", "sequence_id", "length", "stratum", "held_out", "lang_pred", "component_id", "row", "size", "shard", "virtual_slot", "A", "E", "good", "toxic_lost", "runs", "start", "collapsed", "digest", "least")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "the", "cat", "sat", "on", "mat"]) + rng.choice(["", "", "s", "ed"]) for _ in range(n))


def rows():
    rng = random.Random(41)
    long = prose(rng, 230_000)
    assert len(long) > 1_100_000
    out = [(1, "One short text, said twice by one row and its copy"), (1, "One short text, said twice by one row and its copy"), (1, "the same id with another text of some words")]
    out += [(2, None), (3, ""), (None, "a text without an id, but with words enough for shingles"), (None, None), (4, long), (5, long + " and an end"), (6, "12345 67890"), (7, "é" * 300), (7, "é" * 300)]
    return out + [(100 + k, prose(rng, 30 + k)) for k in range(40)]


def with_clashes(df):
    return df.select("*", *(F.lit(1).alias(c) for c in CLASHES if c not in df.columns))


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("awkward"))
    docs = spark.createDataFrame([(d, t, [None, "xx", "yy"][(d or 0) % 3], [None, "hot"][(d or 0) % 2], None if t is None else len(t)) for d, t in rows()], DOCS)
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (2, None), (None, ""), (3, "http://net/es/" + "x" * 300_000), (4, "http://EXAMPLE.com/en/")], "page_id long, url string")
    talk = spark.createDataFrame([(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", None), (None, None, None, None), (2, 0, "user", "x" * 1_200_000)], "conv_id long, turn long, role string, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 0), (3, None, None)] + [(100 + k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("pages", pages), ("conversations", talk), ("labels", labels)):
        with_clashes(df).repartition(3).write.parquet(f"{at}/{name}.parquet")
        df.limit(0).write.parquet(f"{at}/none/{name}.parquet")
    return at


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_awkward_rows(spark, awkward, name):
    got = QUERIES[name](spark, awkward).collect()
    documents = rows()
    if name.startswith("op3"):
        turns = {r["conv_id"]: r["n_turns"] for r in got}
        assert turns == {-1: 2, 1: 3, None: 1, 2: 1}
    elif name.startswith("op9"):
        assert collections.Counter((r["page_id"], r["verdict"]) for r in got) == {(1, "allow"): 2, (2, "allow"): 1, (None, "allow"): 1, (3, "block"): 1, (4, "block"): 1}
    elif name.startswith("op4"):
        firsts = [r for r in got if r["piece"] == 0]
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in firsts) == sorted((d is None, d or 0) for d, _ in documents)
        assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) and max(r["offset"] + r["length"] for r in got) <= 2048
    elif name.startswith("op12"):
        parts = collections.Counter([None, "xx", "yy"][(d or 0) % 3] or "" for d, _ in documents)
        assert len(got) == 600 * len(parts) and all(r["kept"] + r["removed"] <= parts[r["part"]] for r in got)
    else:
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((d is None, d or 0) for d, _ in documents)
        if name.startswith("op11"):  # a row has a place of its own
            assert len({(r["shard"], r["slot"]) for r in got}) == len(got)
        elif not name.startswith("op1_"):  # there a row's follower counts too
            assert len({tuple(r) for r in got if r["doc_id"] == 7}) == 1
            assert len({tuple(r) for r in got if r["doc_id"] == 1}) <= 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, awkward, name):
    assert QUERIES[name](spark, f"{awkward}/none").count() == (1 if name.startswith("op3") else 0)


def test_pipeline_of_awkward_rows(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, awkward), "t")
        if k < 4:
            assert docs.columns == names
        if name == "language_id":
            assert docs.where("text IS NULL OR text = ''").count() == 0 and docs.where("doc_id = 4").count() == 1
        if name == "minhash_near_dedup":
            # The pair of long texts and the repeated rows are one row each; texts of one id that differ stay.
            assert docs.where("doc_id IN (4, 5)").count() == 1 and docs.where("doc_id = 1").count() == 2 and docs.where("doc_id = 7").count() == 1
    assert docs.count() >= 1
    assert corpus_pipeline.run(spark, f"{awkward}/none").count() == 0
