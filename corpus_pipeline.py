"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and gets all that its predecessor kept; all but the last return the columns of docs.

Defined cases, for every stage: rows are told apart by id and text, so null ids and ids that repeat with other texts lose
nothing; null text counts as empty; extra columns come through whatever their names; very long texts are read whole; an
empty table gives an empty result. Without labels of both classes the first stage rejects nothing; of repeated rows the
second keeps one; of near copies the third keeps the smallest id; a document whose whole text repeats stays, empty, after
the fourth and is packed as its end id alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hearthline.llm import exact_dedup, minhash, packing, quality, repeats
from hearthline.llm.common import cut, table


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; documents stay, with n_chars counted anew where they have that column."""
    return repeats.drop_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_text),
    ("exact dedup", no_exact_copies),
    ("MinHash near-dedup", no_near_copies),
    ("suffix-array dedup", no_repeats),
    ("best-fit packing", packed),
]

#: The classifier and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
