"""A corpus pipeline over the operators of ``verbatlas.llm``: STAGES, run and ORACLE_SQL.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbatlas.llm import mixing, near_copies, quality, suffixes, wordtable
from verbatlas.llm.common import written
from verbatlas.llm.queries import table, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the isolation forest reject go."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike in 0.8 of their five-word shingles the document of the smallest id stays."""
    return near_copies.deduplicated(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes are cut out of the texts."""
    return suffixes.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix."""
    return wordtable.encoded(docs, vocabulary("word_bpe_49k.json"), decoded=False)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("suffix dedup", suffix_dedup),
    ("mix sources", mix_sources),
    ("encode", encode),
]

#: Fingerprints, an isolation forest and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
