"""A training corpus from ``documents``: five stages, each over all rows that its predecessor kept.

Stages call the operators of ``sqlatlas.llm``. All but the last return the columns of documents; the last returns
the packed pieces. ``run`` writes every stage's result to the shared folder and rereads it as the next stage's input.

In every stage null ids and repeated ids are rows like any others, extra columns are kept (but for the last stage), and an empty table
gives no rows. What each does with null texts, ties and repeated rows is told there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sqlatlas.llm import decontaminate, exact_dedup, langid, ngram_join, packing
from sqlatlas.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too), or in which no language holds a fair share of the letters, go. Repeated rows are judged alike; ties between languages go to the first by name."""
    return langid.accepted(docs, langid.learn(langid.training(docs)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of the smallest doc_id stays (nulls last); of rows that tie, any one. Null counts as empty."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates exactly one row stays: the smallest doc_id (nulls last), then the least SHA-256 of the text; of rows that agree in both, one. Rows without words all stay."""
    return ngram_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null texts hold none and stay; repeated rows are judged alike."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens. Null text is one token; repeated rows are pieces of their own; ties go by doc_id and piece."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("pack", pack)]

#: SQL has no trained language model, tokenizer or bin completion; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
