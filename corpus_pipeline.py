"""The corpus pipeline: five stages, each over all rows that the one before it kept.

Toxic documents go, then exact copies, then near copies (one document of each group stays), the rest is mixed to
target weights (a document appears as often as the mix takes it), and the mixture is encoded. Rows of the result: one
per document in the mixture, with its number of tokens and the digests of its ids and its decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symloom.llm import bpe, common, exact_dedup, mixing, simhash, toxicity
from symloom.llm.queries import table, tokenizer_path

#: Near copies of the pipeline: texts of which either of two fingerprints is at most so many of 64 bits apart (a wide
#: radius: texts of which four in five five-word shingles are equal are 10 bits apart, give or take 3) and that are as
#: similar as this.
NEAR_BITS, NEAR_PARTS, SIMILARITY = 13, 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, threshold=NEAR_BITS, parts=NEAR_PARTS, similarity=SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("simhash near-dedup", drop_near_copies), ("mixing", mix_sources), ("bpe encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: training, fingerprints and byte pair merges are beyond it; the tests hold every stage against brute force.
ORACLE_SQL = None
