"""A corpus pipeline: language, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), reads what its predecessor kept and
returns the columns of `documents`, but for the last, which returns the packed
pieces.

All stages take nulls in any column, empty and very long texts, rows repeated
under one doc_id, empty tables, and further columns whatever their names; each
says what becomes of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sightline.llm import exact_dedup, language_id, minhash, packing, substring_dedup
from sightline.llm.common import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones; the others go.

    By kernel ridge regression over the languages (null, empty and letterless texts
    go).  Very long texts are read whole; equal texts go or stay together; a null
    doc_id is no reason to go.  Where no row has a label, lettered texts stay.  An
    empty table stays empty, other columns stay as they are.
    """
    return language_id.accept(docs, language_id.fit(docs.where(~language_id.held_out(3, 1))))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id.

    Null and empty texts are equal to each other; a null doc_id loses to any other;
    of rows equal in doc_id and text one stays.  Very long texts are compared whole.
    An empty table stays empty, other columns stay as they are.
    """
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), that with the smallest doc_id.

    Texts without a word, and null texts, are near to nothing and stay; so do rows
    with a null doc_id.  Very long texts are compared by all their shingles.  Rows
    repeated under a doc_id stay or go together.  An empty table stays empty, other
    columns stay as they are.
    """
    return minhash.drop_near_copies(docs, percent=80)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that one with a smaller doc_id has.

    Null, empty and short texts, and rows with a null doc_id, stay as they are.  Very
    long texts are cut wherever they repeat.  Different texts under one doc_id are cut
    each by itself.  An empty table stays empty, other columns stay as they are.
    """
    return substring_dedup.remove_passages(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens.

    A null or empty text is its end token alone; a very long one is cut into pieces of
    several sequences.  Rows repeated under a doc_id, and rows with a null one, are
    documents of their own.  An empty table gives no pieces; other columns are ignored.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", no_exact_copies),
    ("MinHash near-dedup", no_near_copies),
    ("substring dedup", no_repeated_passages),
    ("packing", packed),
]

#: No stage but the second can be put in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
