"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

quality rules -> MinHash near-dedup -> suffix-array dedup -> benchmark decontamination -> BPE encoding.
All stages but the last return the columns of ``documents``; the last returns what training reads: each
document's id, the number of its tokens, their ids, and hashes of the ids and of the decoded text.
Near-duplicates share 0.8 of their five-word shingles. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe_codec, decontaminate, near_dedup, quality_rules, suffix_dedup
from weftline.llm.common import Scratch, remove, scratch_below, table
from weftline.llm.queries import WORD_BPE, tokenizer_path


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.filter_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.deduplicate(docs, shingle_words=5)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that earlier ones hold."""
    return suffix_dedup.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the test items."""
    return decontaminate.filter_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    return bpe_codec.encode_documents(docs, tokenizer_path(WORD_BPE), with_ids=True)


STAGES = [
    ("quality rules", apply_quality_rules),
    ("near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("BPE encoding", encode),
]

#: Near-duplicate components and byte spans aren't expressible in SQL at this size; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage keeps is written to the shared folder before the next.

    A stage's input and working tables go as soon as its result is written; only the last one's input stays, as the result reads it.
    """
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, work = docs, f"{scratch.folder}/work-{i}"
        with scratch_below(work):
            docs = scratch.keep(stage(spark, before, sf_dir))
        scratch.drop(before)
        remove(spark, work)
    return STAGES[-1][1](spark, docs, sf_dir)
