"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in
the shared folder and hands what was written to the next. All but the last return the columns
of documents.

- language ID: documents without a recognised language go.
- MinHash near-dedup: of each group of near-duplicates the smallest doc_id stays.
- suffix-array dedup: passages of 200 bytes and more that occur elsewhere are cut out of the
  texts, n_chars follows; no document goes.
- mixing: documents are sampled so that sources, languages and topics meet their target shares.
- packing: the texts' tokens in sequences of at most 2048.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm.common import materialize, read_table
from voxlake.llm.langid import identify_stage
from voxlake.llm.minhash import near_duplicate_stage
from voxlake.llm.mixing import mix_stage
from voxlake.llm.packing import pack_stage
from voxlake.llm.suffix_dedup import remove_repeated


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text; n_chars follows where something was cut out.

    Null texts stay null and empty ones empty; texts shorter than 200 bytes stay whole, and long ones are taken whole. Rows that
    repeat each other lose what they share, in all of them. Null ids and other columns are handed through; an
    empty table stays empty.
    """
    names = docs.columns
    left = remove_repeated(docs, with_text=True, carry=tuple(n for n in names if n != "text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("carried.n_chars"))
    out = {"text": F.col("kept_text"), "n_chars": n_chars}
    return left.select(*(out.get(n, F.col(f"carried.`{n}`")).alias(n) for n in names))


STAGES = [
    ("language_id", identify_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", suffix_stage),
    ("mixing", mix_stage),
    ("best_fit_packing", pack_stage),
]

#: Language models, shingle sets, suffix orders and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``; awkward rows as each stage says, nothing from an empty table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
