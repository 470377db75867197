"""A corpus pipeline: toxicity, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents. The pipeline has no SQL: none of its stages but the substring removal can be put in SQL.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnsift.llm.common import table
from tarnsift.llm.mixing import mixed
from tarnsift.llm.near_dups import keep_one
from tarnsift.llm.packing import pack_documents
from tarnsift.llm.substrings import without_repeats
from tarnsift.llm.toxicity import without_toxic
from tarnsift.sources.shared import scratch, stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null text is an empty one; rows that repeat, or share an id, are judged each by its
    text; other columns, whatever their names, pass."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least id; near duplicates are those of op1, on 2-word
    shingles. Null and empty texts, and texts without words, all stay, repeated rows once; a row without an id is a document
    of its own."""
    return keep_one(docs, width=2)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that occur earlier are cut out of the texts. No document goes; a null text becomes an empty one,
    a null id counts as the smallest, and n_chars is counted anew."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, by sources and weights; a null source is the last one, a null text has no words, and
    rows that repeat are rows of their own."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents with their places in sequences of 2048 tokens; row_key tells copies apart."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; what a stage stored beside its result is deleted when that is written, and a stage's result when
    the next one has used it. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name, instead_of=docs if i else None, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
