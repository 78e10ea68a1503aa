"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloop.llm import mixing, near_sets, packing, pii, quality, simhash
from scoreloop.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Documents that SimHash (operator 8) puts together are checked by the Jaccard similarity (0.8) of their sets of five-word
    shingles, as are those that share a MinHash band, for near copies of further fingerprints.
    """
    return near_sets.keep_first(docs, also=simhash.near_duplicates)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, path, end_id=1, capacity=4096, keep_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_only),
    ("simhash_near_dedup", near_dedup),
    ("pii_redaction", without_personal_data),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# Several stages rest on a fitted model, a tokenizer or a seeded draw: SQL cannot state them.
ORACLE_SQL: str | None = None
