"""The corpus pipeline: documents in, places of their pieces in training sequences out.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precolens.llm import packing, quality, repeats, simhash
from precolens.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the rules are fitted on those that ``labels`` covers.

    A null or empty text fails the rules. Repeated rows are judged alike. Without documents, or without
    labels, the stage runs all the same.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates by SimHash the document with the smallest doc_id stays, null ids last.

    Shingles of three words, linked at two or fewer differing bits, as in ``op2_simhash``. Texts without
    words, null ones too, are one group. Of repeated rows one stays. No documents give none.
    """
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the texts; n_chars follows. No document goes.

    Null and empty texts stay as they are, as do texts of null ids. Rows that repeat an id are one document.
    """
    return repeats.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining texts and their places in sequences of 2048 tokens.

    A null or empty text is one end token. Rows that repeat an id are packed each. No documents give no pieces. Workers that other stages have used before hold smaller caches.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cached_words=100_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", pack_sequences),
]

# Fingerprints, fitted trees and a tokenizer's ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what a stage keeps is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
