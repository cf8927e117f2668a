"""A corpus pipeline of five of the training-data operators.

Toxic documents go, then exact copies, then near copies (one document of each
group stays), what is left is mixed to source weights, and the mix is packed into
sequences. Each stage works on all that its predecessor kept and is written as
Parquet before the next one reads it. All stages but the last return the columns
of documents, whatever their names; the last returns one row per packed piece.

Defined cases, in every stage: a null text counts as empty, and long ones are read
whole; rows that repeat an id are documents of their own; an empty table gives an
empty one. What a stage does beyond that is said there. Tables between stages stay
in the shared folder, whose owner clears it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clauseloom.llm import op2_toxicity, op4_mixing, op7_ngram_join, op8_exact_dedup, op10_packing
from clauseloom.llm.common import settle
from clauseloom.plans.shipping import bound_batches, ship_package


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    bound_batches(spark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's threshold; the classifier learns from `labels` and the documents given.

    Without labels or a column `lang` the threshold of all holds (1 without toxic
    labels, which drops none); a score equal to the threshold goes; empty texts have
    the score of no words.
    """
    _ready(spark)
    return op2_toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts, the one with the smallest doc_id; null ids last, empty texts are one group."""
    _ready(spark)
    return op8_exact_dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word Jaccard similarity of 0.8 or more, the one with the smallest doc_id.

    Texts under five words and rows with a null id link with nothing and stay.
    """
    _ready(spark)
    return op7_ngram_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document in each pass over its source; documents it takes twice appear twice, those without words not at all.

    A null source is a source of its own.
    """
    _ready(spark)
    return op4_mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens with their places in sequences; an empty text has its end id."""
    _ready(spark)
    return op10_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_jaccard_join", near_dedup), ("mix_sources", mix_sources), ("best_fit_packing", pack)]

#: A trained classifier and token ids can't be expressed in SQL; tests/llm/test_pipeline.py compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
